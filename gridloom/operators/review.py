"""The review queue, readiness of batches and bulk decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import model
from gridloom.fixed_values import REVIEW_REASONS
from gridloom.operators import normalize, skew


def select_items(
    items: DataFrame, status: str | None = None, reason: str | None = None,
    entity_type: str | None = None,
) -> DataFrame:
    """Items that match every filter given; an absent filter is no predicate."""
    for column, wanted in (("status", status), ("reason", reason), ("entity_type", entity_type)):
        if wanted is not None:
            items = items.filter(F.col(column) == wanted)
    return items


def queue(items: DataFrame) -> DataFrame:
    """Most pressing first, then oldest."""
    return items.orderBy(F.col("priority").desc(), F.col("created_at").asc())


def open_counts(items: DataFrame) -> DataFrame:
    """Open items per batch, total and by reason, in one hash aggregation."""
    by_reason = [
        F.count_if(F.col("reason") == r).alias(f"open_{r.lower()}") for r in REVIEW_REASONS
    ]
    return items.filter("status = 'OPEN'").groupBy("batch_id").agg(
        F.count("*").alias("open_items"), *by_reason
    )


def readiness(batches: DataFrame, items: DataFrame) -> DataFrame:
    counts = ["open_items", *[f"open_{r.lower()}" for r in REVIEW_REASONS]]
    return (
        batches.select("batch_id", "status").join(open_counts(items), "batch_id", "left")
        .fillna(0, counts).withColumn("ready", F.col("open_items") == 0)
    )


def open_by_reason(row: DataFrame) -> Column:
    """The by-reason counts of a readiness row as a map without zero entries."""
    entries = F.array_compact(F.array(*[
        F.when(row[f"open_{r.lower()}"] > 0, F.struct(F.lit(r).alias("reason"), row[f"open_{r.lower()}"].alias("n")))
        for r in REVIEW_REASONS
    ]))
    return F.map_from_entries(entries)


def status_after_match(batches: DataFrame, items: DataFrame) -> DataFrame:
    """Any open item sends the batch to review, none makes it ready."""
    return _with_open(batches, items).withColumn(
        "status", F.when(F.col("open_items") > 0, "IN_REVIEW").otherwise("READY")
    ).drop("open_items")


def status_after_review(batches: DataFrame, items: DataFrame) -> DataFrame:
    now = (
        F.when((F.col("open_items") == 0) & (F.col("status") == "IN_REVIEW"), "READY")
        .when((F.col("open_items") > 0) & (F.col("status") == "READY"), "IN_REVIEW")
        .otherwise(F.col("status"))
    )
    return _with_open(batches, items).withColumn("status", now).drop("open_items")


def _with_open(batches: DataFrame, items: DataFrame) -> DataFrame:
    counts = open_counts(items).select("batch_id", "open_items")
    return batches.join(counts, "batch_id", "left").fillna(0, ["open_items"])


def candidate_status(resolution: Column) -> Column:
    """What a decision makes of the record's match candidates; null leaves them alone."""
    return F.when(resolution.isin("ACCEPT", "MERGE", "REMAP"), "CONFIRMED").when(
        resolution == "REJECT", "REJECTED"
    )


@dataclass
class Decided:
    """Frames after a set of decisions."""

    canonical: DataFrame
    candidates: DataFrame
    items: DataFrame
    events: DataFrame
    rejects: DataFrame


def rule_on(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with the item's record and `reject_reason`, null when the decision applies.

    Only an open item can be decided, and only once: the earliest decision counts, every later
    one finds the item resolved. `decisions` carries a unique decision_id to break ties.
    """
    targets = items.select(
        "review_item_id", "batch_id", "record_id", "entity_type",
        F.col("status").alias("item_status"),
    )
    firsts = decisions.groupBy("review_item_id").agg(
        F.count("*").alias("n_refs"),
        F.min(F.struct("decided_at", "decision_id")).alias("_first"),
    ).join(targets, "review_item_id", "left").withColumn(
        "target", F.struct("batch_id", "record_id", "entity_type", "item_status", "_first")
    )
    ruled = skew.lookup(decisions, firsts, on=("review_item_id",), take=("target",),
                        weight="n_refs", spread_by=(F.col("decision_id"),))
    reason = (
        F.when(F.col("target.record_id").isNull(), "not_found")
        .when(F.col("target.item_status") != "OPEN", "not_open")
        .when(F.col("target._first.decision_id") != F.col("decision_id"), "not_open")
    )
    return ruled.select(
        *decisions.columns, F.col("target.batch_id").alias("batch_id"),
        F.col("target.record_id").alias("record_id"),
        F.col("target.entity_type").alias("entity_type"), reason.alias("reject_reason"),
    )


def record_effects(applied: DataFrame) -> DataFrame:
    """Per record, what its applied decisions amount to, taken in time order.

    Later edits override earlier ones field by field; the latest decision that speaks about
    candidates sets their status; target ids come from the latest remap that names them. Fields are
    gathered from edits only, so that other decisions do not carry two columns for each of them.
    """
    at = F.struct("decided_at", "decision_id")

    def latest(value: Column, where: Column) -> Column:
        return F.max_by(value, F.when(where, at))

    editing = F.col("resolution") == "EDIT"
    edits = []
    for f in model.CANONICAL_FIELDS:
        named = F.coalesce(F.map_contains_key("fields", f), F.lit(False))
        edits += [F.bool_or(named).alias(f"_has_{f}"),
                  latest(F.try_element_at("fields", F.lit(f)), named).alias(f"_new_{f}")]
    status = candidate_status(F.col("resolution"))
    remap = F.col("resolution") == "REMAP"
    fields = applied.filter(editing & F.col("record_id").isNotNull()).groupBy("record_id").agg(*edits)
    return applied.groupBy("record_id").agg(
        F.bool_or(editing).alias("edited"),
        latest(status, status.isNotNull()).alias("new_candidate_status"),
        latest(F.col("target_record_id"), remap & F.col("target_record_id").isNotNull())
        .alias("new_target_record"),
        latest(F.col("target_external_id"), remap & F.col("target_external_id").isNotNull())
        .alias("new_target_external"),
    ).join(fields, "record_id", "left")


def edit_records(canonical: DataFrame, effects: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """Canonical rows after the decisions: bodies merged, keys derived again, status REVIEWED.

    Only edited rows meet the fields of the edits; of the others the status is all that can change.
    `edits` are the effects of edited records, if they are at hand.
    """
    edited = F.coalesce("edited", F.lit(False))
    plain = canonical.join(effects.select("record_id", "edited"), "record_id", "left").filter(~edited).withColumn(
        "status", F.when(F.col("edited").isNotNull(), "REVIEWED").otherwise(F.col("status")))
    rows = canonical.join(effects.filter(edited) if edits is None else edits, "record_id")

    def merged(f: str) -> Column:
        given = F.col(f"_new_{f}")
        new = given.try_cast(model.field_type(f))
        # text that is no number leaves the number as it was
        return F.when(F.col(f"_has_{f}") & (new.isNotNull() | given.isNull()), new).otherwise(F.col(f"data.{f}")).alias(f)

    changed = normalize.derive(rows.withColumns({
        "data": F.struct(*[merged(f) for f in model.CANONICAL_FIELDS]), "status": F.lit("REVIEWED")}))
    return plain.select(*canonical.columns).unionByName(changed.select(*canonical.columns))


def mark_candidates(candidates: DataFrame, effects: DataFrame) -> DataFrame:
    """All candidates of a decided record follow the decision, whichever item it was about."""
    slim = effects.select("record_id", "new_candidate_status", "new_target_record",
                          "new_target_external")
    return candidates.join(slim, "record_id", "left").withColumns({
        "status": F.coalesce("new_candidate_status", "status"),
        "target_record_id": F.coalesce("new_target_record", "target_record_id"),
        "target_external_id": F.coalesce("new_target_external", "target_external_id"),
    }).select(*candidates.columns)


def resolve_items(items: DataFrame, applied: DataFrame) -> DataFrame:
    done = applied.select(
        "review_item_id", F.col("resolution").alias("_resolution"),
        F.col("resolved_by").alias("_by"), F.col("decided_at").alias("_at"),
    )

    def now(column: str, new: str) -> Column:
        return F.coalesce(new, column) if column in items.columns else F.col(new)

    return items.join(done, "review_item_id", "left").withColumns({
        "status": F.when(F.col("_resolution").isNotNull(), "RESOLVED").otherwise(F.col("status")),
        "resolution": now("resolution", "_resolution"),
        "resolved_by": now("resolved_by", "_by"),
        "resolved_at": now("resolved_at", "_at"),
    }).drop("_resolution", "_by", "_at")


def review_events(applied: DataFrame) -> DataFrame:
    """One audit row per applied decision."""
    return applied.select(
        F.concat_ws(":", "review_item_id", F.lit("event")).alias("event_id"),
        "review_item_id", "batch_id", F.col("resolution").alias("action"),
        F.lit("OPEN").alias("from_status"), F.lit("RESOLVED").alias("to_status"),
        F.col("resolved_by").alias("actor"), F.col("decided_at").alias("created_at"),
    )


def suppression_warning(candidates: DataFrame, items: DataFrame, applied: DataFrame) -> DataFrame:
    """Records whose duplicate candidate got confirmed by deciding a validation item only."""
    by_validation = applied.join(
        items.select("review_item_id", "reason"), "review_item_id"
    ).groupBy("record_id").agg(F.bool_and(F.col("reason") == "VALIDATION_ERROR").alias("only"))
    return candidates.filter("status = 'CONFIRMED' and target_kind = 'INTRA_BATCH'").join(
        by_validation.filter("only"), "record_id", "left_semi"
    ).select("batch_id", "record_id", F.lit("suppressed by a validation decision").alias("warning"))


def decide(
    canonical: DataFrame, candidates: DataFrame, items: DataFrame, decisions: DataFrame
) -> Decided:
    """Apply a table of decisions to items, records and candidates in bulk."""
    ruled = rule_on(items, decisions)
    applied = ruled.filter("reject_reason is null").drop("reject_reason")
    effects = record_effects(applied)
    return Decided(
        canonical=edit_records(canonical, effects),
        candidates=mark_candidates(candidates, effects),
        items=resolve_items(items, applied),
        events=review_events(applied),
        rejects=ruled.filter("reject_reason is not null"),
    )
