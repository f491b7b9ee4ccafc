"""Batches over their life: counters, retries, failures, detail, timeline and purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import review, skew


def merge_counts(base: Column, patch: Column, fields: tuple[str, ...]) -> Column:
    """Stage counters: the patch wins field by field, `timings` merge key by key."""
    merged = []
    for f in fields:
        b, p = base.getField(f), patch.getField(f)
        if f == "timings":
            empty = F.expr("cast(map() as map<string,bigint>)")
            old, new = F.coalesce(b, empty), F.coalesce(p, empty)
            kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
            merged.append(F.map_concat(kept, new).alias(f))
        else:
            merged.append(F.coalesce(p, b).alias(f))
    return F.struct(*merged)


def with_status(batches: DataFrame, status: str | None = None, session_id: str | None = None) -> DataFrame:
    if status is not None:
        batches = batches.filter(F.col("status") == status)
    if session_id is not None:
        batches = batches.filter(F.col("session_id") == session_id)
    return batches


def newest_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.col("created_at").desc())


def records_per_type(canonical: DataFrame) -> DataFrame:
    return canonical.groupBy("batch_id", "entity_type").agg(F.count("*").alias("records"))


def detail(batches: DataFrame, sources: DataFrame, artifacts: DataFrame, extracted: DataFrame) -> DataFrame:
    """Batches with their source, artifact and number of extracted rows."""
    rows = extracted.groupBy("batch_id").agg(F.count("*").alias("extracted_records"))
    return (
        batches.join(sources, "source_id", "left").join(artifacts, "batch_id", "left")
        .join(rows, "batch_id", "left").fillna(0, ["extracted_records"])
    )


def retry(batches: DataFrame, actions: DataFrame) -> DataFrame:
    """Batches set back to EXTRACTED; one with committed actions is rejected instead."""
    committed = actions.groupBy("batch_id").agg(
        F.count_if(F.col("status") == "COMMITTED").alias("_committed")
    )
    bad = F.coalesce("_committed", F.lit(0)) > 0
    return batches.join(committed, "batch_id", "left").withColumns({
        "status": F.when(bad, F.col("status")).otherwise("EXTRACTED"),
        "error_stage": F.when(bad, F.col("error_stage")),
        "error_message": F.when(bad, F.col("error_message")),
        "reject_reason": F.when(bad, F.lit("batch has committed actions")),
    }).drop("_committed")


def mark_failed(batches: DataFrame, failures: DataFrame) -> DataFrame:
    """Batches with a failure (batch_id, stage, message) become FAILED and carry it."""
    hit = F.col("_stage").isNotNull()
    return batches.join(
        failures.select("batch_id", F.col("stage").alias("_stage"), F.col("message").alias("_message")),
        "batch_id", "left",
    ).withColumns({
        "status": F.when(hit, "FAILED").otherwise(F.col("status")),
        "error_stage": F.coalesce("_stage", "error_stage"),
        "error_message": F.coalesce("_message", "error_message"),
    }).drop("_stage", "_message")


def timeline(batches: DataFrame, items: DataFrame, events: DataFrame, actions: DataFrame) -> DataFrame:
    """One stream of rows per batch: status, readiness, review events, then the action log."""
    none = F.lit(None)
    ready = review.readiness(batches, items)

    def part(rows: DataFrame, rank: int, kind: str, at: Column, seq: Column, label: Column, ref: Column) -> DataFrame:
        return rows.select(
            "batch_id", F.lit(rank).alias("part"), F.lit(kind).alias("kind"),
            at.cast("timestamp_ntz").alias("at"), seq.cast("bigint").alias("sequence"),
            label.cast("string").alias("label"), ref.cast("string").alias("ref_id"),
        )

    return (
        part(batches, 0, "batch", F.col("updated_at"), none, F.col("status"), F.col("batch_id"))
        .unionByName(part(ready, 1, "readiness", none, none, F.format_string(
            "%s open", F.col("open_items").cast("string")), F.col("batch_id")))
        .unionByName(part(events, 2, "review", F.col("created_at"), none, F.col("action"),
                          F.col("review_item_id")))
        .unionByName(part(actions, 3, "action", none, F.col("sequence"),
                          F.concat_ws(" ", "op", "status"), F.col("action_id")))
    )


def timeline_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("batch_id", "part", "at", "sequence", "ref_id")


#: tables that go with their batch
BATCH_CHILDREN = ("artifacts", "extracted", "canonical", "match_candidates", "review_items",
                  "review_events", "publish_actions")
#: tables that go with their session
SESSION_CHILDREN = ("sources", "batches")


def purge_sessions(tables: dict[str, DataFrame], session_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the given sessions and everything below them."""
    out = dict(tables)
    gone = skew.without(tables["batches"], session_ids, "session_id", keep=True).select("batch_id")
    if "sessions" in out:
        out["sessions"] = skew.without(tables["sessions"], session_ids, "session_id")
    for name in SESSION_CHILDREN:
        if name in out:
            out[name] = skew.without(tables[name], session_ids, "session_id")
    return purge_batches(out, gone)


def purge_batches(tables: dict[str, DataFrame], batch_ids: DataFrame) -> dict[str, DataFrame]:
    out = dict(tables)
    for name in ("batches", *BATCH_CHILDREN):
        if name in out:
            out[name] = skew.without(out[name], batch_ids, "batch_id")
    return out


def clear_lost(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference to a removed parent is set to null (source rows, reversed actions)."""
    known = parents.select(F.col(key).alias(column)).withColumn("_there", F.lit(True))
    table = skew.weighted(rows, known, (column,))
    spread = (F.struct(*[F.col(c) for c in rows.columns]),)
    marked = skew.lookup(rows, table, (column,), ("_there",), "n_refs", spread)
    return marked.withColumn(
        column, F.when(F.col("_there"), F.col(column))
    ).select(*rows.columns)
