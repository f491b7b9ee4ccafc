"""Natural-key references between entities and matches to existing platform entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import match_key
from gridloom.lineage import materialize
from gridloom.operators import skew

#: (entity, reference field, referenced entity)
REFERENCES = (
    ("BOOKING", "productRef", "PRODUCT"),
    ("BOOKING", "travelerRef", "TRAVELER"),
    ("QUALIFICATION", "guideRef", "GUIDE"),
    ("STAFFING_RULE", "productRef", "PRODUCT"),
    ("STAFFING_RULE", "qualificationRef", "QUALIFICATION"),
)
#: keys a reference may name its target by, strongest first
KEY_ORDER = ("email", "code", "name")


def reference_rows(canonical: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per filled reference: record_id, field, target_type and the key it names."""
    entries = F.array(*[
        F.when(F.col("entity_type") == owner, F.struct(
            F.lit(field).alias("field"), F.lit(target).alias("target_type"),
            match_key(F.col(f"data.{field}")).alias("ref_key"),
        )) for owner, field, target in REFERENCES
    ])
    return canonical.select(
        *scope, "batch_id", "record_id", "row_ord", F.inline(F.array_compact(entries))
    ).filter("ref_key is not null")


def target_keys(canonical: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Per referenced entity and key the record it stands for: the strongest, earliest holder."""
    keys = F.array_compact(F.array(*[
        F.when(F.col(f"key_{kind}").isNotNull(), F.struct(
            F.lit(rank).alias("rank"), F.col(f"key_{kind}").alias("ref_key")))
        for rank, kind in enumerate(KEY_ORDER)
    ]))
    return canonical.select(
        *scope, F.col("entity_type").alias("target_type"), "batch_id", "row_ord", "record_id",
        "external_id", F.inline(keys),
    ).groupBy(*scope, "target_type", "ref_key").agg(
        F.min(F.struct("rank", "batch_id", "row_ord", "record_id", "external_id")).alias("_t")
    ).select(*scope, "target_type", "ref_key",
             F.col("_t.record_id").alias("target_record_id"),
             F.col("_t.external_id").alias("target_external_id"))


def resolve_references(canonical: DataFrame, scope: Sequence[str] = ("session_id",)) -> DataFrame:
    """Every reference with its target; target_record_id is null for an orphan."""
    # counted by key and looked up
    refs = materialize(reference_rows(canonical, scope))
    on = (*scope, "target_type", "ref_key")
    named = canonical.filter(F.col("entity_type").isin(*sorted({target for _, _, target in REFERENCES})))
    # both the heavy and the other keys are looked up in it
    targets = materialize(skew.weighted(refs, target_keys(named, scope), on))
    return skew.lookup(refs, targets, on=on, take=("target_record_id", "target_external_id"),
                       weight="n_refs", spread_by=(F.col("record_id"), F.col("field")))


def orphans(resolved: DataFrame) -> DataFrame:
    return resolved.filter("target_record_id is null")


def match_existing(canonical: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Candidates against a snapshot of existing entities: first hit by email, code, name."""
    kinds = F.array(*[F.lit(k) for k in KEY_ORDER])
    existing = snapshot.select("entity_type", "external_id", F.posexplode(
        F.array(*[match_key(F.col(k)) for k in KEY_ORDER])).alias("rank", "key")
    ).filter("key is not null").groupBy("entity_type", "rank", "key").agg(
        F.min("external_id").alias("hit")
    )
    asked = canonical.select("batch_id", "record_id", "entity_type", F.posexplode(
        F.array(*[F.col(f"key_{k}") for k in KEY_ORDER])).alias("rank", "key")
    ).filter("key is not null")
    on = ("entity_type", "rank", "key")
    hits = skew.lookup(asked, skew.weighted(asked, existing, on), on=on, take=("hit",),
                       weight="n_refs", spread_by=(F.col("record_id"),)).filter("hit is not null")
    best = hits.groupBy("batch_id", "record_id", "entity_type").agg(
        F.min(F.struct("rank", "hit")).alias("_b")
    )
    strategy = F.concat(F.get(kinds, F.col("_b.rank")), F.lit("_exact"))
    return best.select(
        "batch_id", F.concat_ws(":", "record_id", F.lit("existing")).alias("candidate_id"),
        "record_id", "entity_type",
        F.lit("EXISTING_PLATFORM").alias("target_kind"),
        F.col("_b.hit").alias("target_external_id"),
        F.lit(None).cast("string").alias("target_record_id"),
        F.lit(1.0).alias("score"), strategy.alias("strategy"),
        F.lit("CANDIDATE").alias("status"),
        F.lit("Matches an existing entity.").alias("explanation"),
    )
