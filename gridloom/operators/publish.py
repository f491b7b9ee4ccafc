"""Publish plans: state gates, operations, sequence numbers and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.fixed_values import ALLOWED_FROM, PUBLISH_OPS
from gridloom.functions.publishing import idempotency_key, payload_json
from gridloom.operators import skew
from gridloom.operators.review import open_counts

#: rows numbered together; a chunk of the packed row order holds at most 2^16 rows
CHUNK_BITS = 16


def gate(batches: DataFrame, step: str, items: DataFrame | None = None) -> DataFrame:
    """Batches with `reject_reason`, null where the step may run.

    Preview and commit first ask for zero open review items, then for a fitting status;
    rollback only asks for the status.
    """
    rows = batches
    blocked = F.lit(False)
    if items is not None and step != "rollback":
        counts = open_counts(items).select("batch_id", "open_items")
        rows = rows.join(counts, "batch_id", "left").fillna(0, ["open_items"])
        blocked = F.col("open_items") > 0
    reason = (
        F.when(blocked, F.format_string(
            "batch %s has %s unresolved review item(s)", "batch_id",
            F.col("open_items").cast("string") if items is not None and step != "rollback" else F.lit("0"),
        ))
        .when(~F.col("status").isin(*ALLOWED_FROM[step]), F.format_string(
            f"batch %s cannot {step} from status %s", "batch_id", "status"))
    )
    return rows.withColumn("reject_reason", reason).select(*batches.columns, "reject_reason")


def decide_op(canonical: DataFrame, candidates: DataFrame) -> DataFrame:
    """Canonical rows with `op` and `target_external_id`; op is null for suppressed rows.

    A row confirmed as a duplicate within its batch is represented by its peer. A row confirmed
    against an existing entity updates it. Everything else is created.
    """
    confirmed = candidates.filter("status = 'CONFIRMED'").groupBy("record_id").agg(
        F.bool_or(F.col("target_kind") == "INTRA_BATCH").alias("_merged"),
        F.min(F.when(F.col("target_kind") != "INTRA_BATCH", F.col("target_external_id")))
        .alias("target_external_id"),
    )
    op = (
        F.when(F.coalesce("_merged", F.lit(False)), None)
        .when(F.col("target_external_id").isNotNull(), "UPDATE").otherwise("CREATE")
    )
    return canonical.join(confirmed, "record_id", "left").withColumn("op", op).drop("_merged")


def number_rows(rows: DataFrame, name: str = "sequence") -> DataFrame:
    """Number rows 0, 1, 2, ... in row order within each batch, without sorting a whole batch.

    A chunk is a stretch of the packed row order and holds at most 2^CHUNK_BITS rows, whatever
    the batch holds. Chunk sizes are summed up first (one row per chunk), then rows are numbered
    inside their chunk from the chunk's offset. Row shuffle and sort stay within chunks.
    """
    chunked = rows.withColumn("_chunk", F.shiftright("row_ord", CHUNK_BITS))
    before = Window.partitionBy("batch_id").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = chunked.groupBy("batch_id", "_chunk").count().select(
        "batch_id", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy("batch_id", "_chunk").orderBy("row_ord"))
    return (
        chunked.join(offsets, ["batch_id", "_chunk"])
        .withColumn(name, F.col("_offset") + inside - 1)
        .drop("_chunk", "_offset")
    )


def plan(canonical: DataFrame, candidates: DataFrame) -> DataFrame:
    """The planned actions of a set of batches that passed the gate."""
    chosen = decide_op(canonical, candidates).filter("op is not null")
    return number_rows(chosen).select(
        "batch_id",
        F.concat_ws(":", "record_id", "op").alias("action_id"),
        "record_id", "entity_type", "op",
        F.lit("PLANNED").alias("status"),
        "sequence",
        payload_json(F.col("data")).alias("payload"),
        "target_external_id",
        F.lit(None).cast("string").alias("result_external_id"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("compensation_of"),
        idempotency_key(F.col("batch_id"), F.col("record_id"), F.col("op")).alias("idempotency_key"),
    )


def replan(actions: DataFrame, planned: DataFrame, previewed: DataFrame | None = None) -> DataFrame:
    """Actions after a preview: PLANNED rows of the previewed batches are rebuilt, others stay.

    `previewed` names the batches (batch_id) when some of them may have nothing left to plan.
    """
    done = planned if previewed is None else previewed
    stale = skew.without(actions.filter("status = 'PLANNED'"), done, "batch_id")
    return actions.filter("status <> 'PLANNED'").unionByName(stale).unionByName(planned)


def plan_summary(actions: DataFrame) -> DataFrame:
    """Per batch: total, count by op and count by status, in one aggregation."""
    ops = [F.count_if(F.col("op") == o).alias(f"op_{o.lower()}") for o in PUBLISH_OPS]
    states = [
        F.count_if(F.col("status") == s).alias(f"status_{s.lower()}")
        for s in ("PLANNED", "COMMITTED", "FAILED", "ROLLED_BACK")
    ]
    return actions.groupBy("batch_id").agg(F.count("*").alias("total"), *ops, *states)


def work_set(actions: DataFrame) -> DataFrame:
    """What is still to be sent, in order: planned and failed actions."""
    return actions.filter(F.col("status").isin("PLANNED", "FAILED")).orderBy("batch_id", "sequence")


def unplanned(batches: DataFrame, actions: DataFrame) -> DataFrame:
    """Batches a commit must plan first: nothing pending and nothing committed."""
    counts = actions.groupBy("batch_id").agg(
        F.count_if(F.col("status").isin("PLANNED", "FAILED", "COMMITTED")).alias("_n")
    )
    return batches.join(counts.filter("_n > 0"), "batch_id", "left_anti")


def action_log(actions: DataFrame, batch_id: Column | None = None) -> DataFrame:
    rows = actions if batch_id is None else actions.filter(F.col("batch_id") == batch_id)
    return rows.orderBy("batch_id", F.col("sequence").asc(), F.col("created_at").asc())
