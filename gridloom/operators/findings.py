"""Duplicate findings of a batch and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import model
from gridloom.fixed_values import (
    DUPLICATE_THRESHOLD, ENTITY_LABELS, EXACT_TEXT, FUZZY_DUPLICATE_TAIL, FUZZY_POSSIBLE_TAIL,
    FUZZY_TEXT, PRIORITY,
)
from gridloom.functions.similarity import similarity
from gridloom.lineage import materialize
from gridloom.operators import exact_match, fuzzy_match, skew

_COLUMNS = ("batch_id", "record_id", "row_ord", "entity_type", "strategy", "score", "reason",
            "peer_ord", "explanation")


def entity_label(entity_type: Column) -> Column:
    out = F
    for name, text in ENTITY_LABELS.items():
        out = out.when(entity_type == name, text)
    return out


def exact_findings(annotated: DataFrame) -> DataFrame:
    by_email = F.col("exact_kind") == "email"
    text = F.format_string(
        EXACT_TEXT, F.col("exact_kind"),
        F.when(by_email, F.col("key_email")).otherwise(F.col("key_code")),
        entity_label(F.col("entity_type")),
    )
    return annotated.filter("exact_kind is not null").withColumns({
        "strategy": F.concat(F.col("exact_kind"), F.lit("_exact")),
        "score": F.lit(1.0),
        "reason": F.lit("DUPLICATE"),
        "peer_ord": F.col("exact_peer_ord"),
        "explanation": text,
    }).select(*_COLUMNS)


def fuzzy_findings(annotated: DataFrame) -> DataFrame:
    """Findings of named rows that no exact key explained."""
    rest = annotated.filter("exact_kind is null and key_name is not null").select(
        "batch_id", "record_id", "row_ord", "entity_type", "key_name"
    )
    names = materialize(fuzzy_match.distinct_names(rest))
    best = fuzzy_match.earliest_similar(names)
    # A later holder of the same name has that name's first row as a candidate too.
    by_best = F.col("best_ord").isNotNull() & (F.col("best_ord") < F.col("first_ord"))
    peers = best.filter(by_best | (F.col("holders") > 1)).select(
        "batch_id", "entity_type", F.col("name").alias("key_name"), "holders",
        F.when(by_best, F.col("best_ord")).otherwise(F.col("first_ord")).alias("peer_ord"),
        F.when(by_best, F.col("best_name")).otherwise(F.col("name")).alias("peer_name"),
    )
    found = skew.lookup(
        rest, peers, on=("batch_id", "entity_type", "key_name"), take=("peer_ord", "peer_name"),
        weight="holders", spread_by=(F.col("batch_id"), F.col("row_ord")),
    ).filter(F.col("peer_ord") < F.col("row_ord"))
    scored = found.withColumn("score", similarity(F.col("key_name"), F.col("peer_name")))
    sure = F.col("score") >= DUPLICATE_THRESHOLD
    text = F.format_string(
        FUZZY_TEXT, "key_name", F.floor(F.col("score") * 100 + 0.5).cast("string"), "peer_name",
        entity_label(F.col("entity_type")),
        F.when(sure, FUZZY_DUPLICATE_TAIL).otherwise(FUZZY_POSSIBLE_TAIL),
    )
    return scored.withColumns({
        "strategy": F.lit("name_fuzzy"),
        "reason": F.when(sure, "DUPLICATE").otherwise("LOW_CONFIDENCE"),
        "explanation": text,
    }).select(*_COLUMNS)


def find_duplicates(records: DataFrame, one_key: bool = False) -> DataFrame:
    """At most one finding per row: same e-mail, else same code, else a similar name.

    `one_key` holds for rows whose keys were derived here (see `exact_match.annotate`).
    """
    annotated = materialize(exact_match.annotate(records.select(
        "batch_id", "record_id", "row_ord", "entity_type", "key_email", "key_code", "key_name"
    ), one_key))
    both = exact_findings(annotated).unionByName(fuzzy_findings(annotated))
    return both.withColumn("peer_record_id", model.record_id(F.col("batch_id"), F.col("peer_ord")))


def match_candidates(findings: DataFrame) -> DataFrame:
    return findings.select(
        "batch_id",
        F.concat_ws(":", "record_id", "strategy").alias("candidate_id"),
        "record_id", "entity_type",
        F.lit("INTRA_BATCH").alias("target_kind"),
        F.lit(None).cast("string").alias("target_external_id"),
        F.col("peer_record_id").alias("target_record_id"),
        "score", "strategy",
        F.lit("CANDIDATE").alias("status"),
        "explanation",
    )


def review_items(findings: DataFrame) -> DataFrame:
    return findings.select(
        "batch_id",
        F.concat_ws(":", "record_id", "reason").alias("review_item_id"),
        "record_id", "row_ord", "entity_type", "reason",
        F.lit("OPEN").alias("status"),
        F.when(F.col("reason") == "DUPLICATE", PRIORITY["DUPLICATE"])
        .otherwise(PRIORITY["LOW_CONFIDENCE"]).alias("priority"),
        "explanation", "strategy", "score", "peer_record_id",
    )


def match_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("batch_id").agg(
        F.count("*").alias("match_candidates"),
        F.count_if(F.col("reason") == "DUPLICATE").alias("duplicates"),
        F.count_if(F.col("reason") == "LOW_CONFIDENCE").alias("low_confidence"),
    )
