"""Driver queries that run whole lifecycles over a store: publishing, failures, retries and rejects."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.lineage import shared_dir
from gridloom.plans import driver_inputs as inp
from gridloom.plans import pipeline
from gridloom.plans.registry import query
from gridloom.sources.csv_files import batch_of_file
from gridloom.sources.store import Store
from gridloom.streaming.landing import watch


def _store(spark) -> Store:
    return Store(f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=8)


def _uploads(spark, sf, raw: inp.Raw, name: str) -> DataFrame:
    """Raw rows as those of files named after their batch."""
    return inp.extracted(spark, sf, raw).select(
        F.concat("batch_id", F.lit(f"/{name}.csv")).alias("source_file"), "sheet_index",
        F.lit(None).cast("string").alias("sheet_name"), "source_row_index", "cells")


_OWN = "split_part(source_file, '/', 1)"
_NUMBER = "CAST(substr(batch_id, 2) AS INT)"

# Orders as bookings in 23 uploads of four sessions. Upload 5 stays in review. A third is previewed, the others are
# planned by the commit. In uploads 1, 5, 9, ... sending stops at the first booking with number 7 modulo 50; all of
# these but 9 are committed again. Then two sessions take their last upload back.
_LOANS = replace(inp.BOOKINGS, batch="concat('L', o_custkey % 23)")
_STOPS = f"({_NUMBER} % 4 = 1 AND ord % 50 = 7)"


@query("stored_lifecycle", f"""
  WITH a AS (SELECT batch_id, ord, {_NUMBER} AS n, row_number() OVER (PARTITION BY batch_id ORDER BY ord) - 1 AS seq, {_STOPS} AS bad
             FROM (SELECT concat('L', o_custkey % 23) AS batch_id, o_orderkey AS ord FROM orders)),
  stops AS (SELECT batch_id, n, min(seq) FILTER (bad) AS stop, min_by(ord, seq) FILTER (bad) AS stop_ord, count(*) AS records FROM a GROUP BY ALL),
  first AS (SELECT *, n <> 5 AS asked, stop IS NOT NULL AND n <> 5 AS broke, n % 4 = 1 AND n NOT IN (5, 9) AS again FROM stops),
  state AS (SELECT *, concat('s', n % 4) AS session_id,
      CASE WHEN NOT asked THEN 'IN_REVIEW' WHEN broke AND NOT again THEN 'FAILED' ELSE 'COMMITTED' END AS status,
      CASE WHEN NOT asked THEN 0 WHEN broke AND NOT again THEN stop ELSE records END AS done FROM first),
  ranked AS (SELECT *, status = 'COMMITTED' AND n % 4 < 2 AND row_number() OVER (
      PARTITION BY session_id, status ORDER BY again DESC, batch_id DESC) = 1 AS back FROM state)
  SELECT batch_id, session_id, CASE WHEN back THEN 'ROLLED_BACK' ELSE status END AS status, records,
    CASE WHEN back THEN 0 ELSE done END AS published,
    CASE WHEN status = 'FAILED' THEN records - done - 1 ELSE 0 END AS planned, CASE WHEN back THEN 0 ELSE done END AS committed,
    CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END AS failed, CASE WHEN back THEN done ELSE 0 END AS rolled_back,
    CASE WHEN back THEN done ELSE 0 END AS deactivated,
    CASE WHEN status = 'FAILED' THEN concat('boom ', stop_ord) END AS error_message, NOT asked AS rejected FROM ranked""")
def stored_lifecycle(spark, sf):
    """Ingest, review, preview, a partly failed commit, its resumption and rollback of the latest, stored."""
    store = _store(spark)
    first, second = (F.lit(f"2026-01-0{d} 00:00:00").cast("timestamp_ntz") for d in (1, 2))
    pipeline.ingest(_uploads(spark, sf, _LOANS, "bookings"), store, batch_id=F.expr(_OWN),
                    session_id=F.concat(F.lit("s"), F.expr(_NUMBER) % 4), at=first)
    items = store.read(spark, pipeline.ITEMS).filter(F.expr(_NUMBER) != 5)
    pipeline.decide(spark, store, items.select(
        F.col("review_item_id").alias("decision_id"), "review_item_id", F.lit("REJECT").alias("resolution"),
        F.lit("driver").alias("resolved_by"), first.alias("decided_at"),
        F.lit(None).cast("map<string,string>").alias("fields"), F.lit(None).cast("string").alias("target_record_id"),
        F.lit(None).cast("string").alias("target_external_id")))
    batches = store.read(spark, pipeline.BATCHES).select("batch_id")
    pipeline.preview(spark, store, batches.filter(F.expr(_NUMBER) % 3 == 0))
    records = store.read(spark, pipeline.CANONICAL).select(
        "batch_id", F.concat("record_id", F.lit(":CREATE")).alias("action_id"),
        F.split_part("record_id", F.lit(":"), F.lit(3)).cast("bigint").alias("ord"))
    bad = F.expr(_STOPS)
    sent = records.select("action_id", (~bad).alias("ok"), F.lit(None).cast("string").alias("external_id"),
                          F.when(bad, F.concat(F.lit("boom "), "ord")).alias("error"))
    absent = batches.limit(1).select(F.lit("L99").alias("batch_id"))
    rejected = pipeline.commit(spark, store, batches.unionByName(absent), sent, first)[1]
    again = batches.filter(f"{_NUMBER} % 4 = 1 AND {_NUMBER} NOT IN (5, 9)")
    pipeline.commit(spark, store, again, sent.withColumn("ok", F.lit(True)), second)
    sessions = batches.limit(1).select(F.explode(F.array(*map(F.lit, ("s0", "s1", "s9")))).alias("session_id"))
    pipeline.rollback_latest(spark, store, sessions, second)

    def has(status: str, op: str | None = None):
        wanted = F.col("status") == status
        return F.count_if(wanted if op is None else wanted & (F.col("op") == op))

    actions = store.read(spark, pipeline.ACTIONS).groupBy("batch_id").agg(
        has("PLANNED").alias("planned"), has("COMMITTED").alias("committed"), has("FAILED").alias("failed"),
        has("ROLLED_BACK", "CREATE").alias("rolled_back"), has("ROLLED_BACK", "DEACTIVATE").alias("deactivated"))
    made = store.read(spark, pipeline.CANONICAL).groupBy("batch_id").agg(
        F.count("*").alias("records"), has("PUBLISHED").alias("published"))
    return (
        store.read(spark, pipeline.BATCHES).select("batch_id", "session_id", "status", "error_message")
        .join(made, "batch_id", "left").join(actions, "batch_id", "left")
        .join(rejected.select("batch_id", F.lit(True).alias("rejected")), "batch_id", "left")
        .fillna(0, ["planned", "committed", "failed", "rolled_back", "deactivated"]).fillna(False, ["rejected"])
        .select("batch_id", "session_id", "status", "records", "published", "planned", "committed", "failed",
                "rolled_back", "deactivated", "error_message", "rejected"))


# Guides in uploads by nation; one upload fails and is retried, one session is purged.
_CREW = replace(inp.GUIDES, batch="concat('C', s_nationkey % 6)")
_CREW_SQL = inp.people_sql(_CREW, "Guide Name", "mail", None)


@query("stored_retry_and_purge", f"""
  WITH r AS (SELECT * FROM ({_CREW_SQL})), f AS ({inp.findings_sql(_CREW_SQL)}),
  n AS (SELECT batch_id, count(*) AS normalized, count(*) FILTER (errors <> '') AS validation_flags FROM r GROUP BY batch_id),
  m AS (SELECT batch_id, count(*) AS match_candidates, count(*) FILTER (reason = 'DUPLICATE') AS duplicates,
               count(*) FILTER (reason = 'LOW_CONFIDENCE') AS low_confidence FROM f GROUP BY batch_id)
  SELECT batch_id, CASE WHEN validation_flags + coalesce(match_candidates, 0) = 0 THEN 'READY'
      WHEN batch_id = 'C3' THEN 'FAILED' ELSE 'IN_REVIEW' END AS status,
    normalized, validation_flags, coalesce(match_candidates, 0) AS match_candidates, coalesce(duplicates, 0) AS duplicates,
    coalesce(low_confidence, 0) AS low_confidence, normalized AS stored_records,
    validation_flags + coalesce(match_candidates, 0) AS stored_items, CAST(substr(batch_id, 2) AS INT) % 3 <> 2 AS timed
  FROM n LEFT JOIN m USING (batch_id) WHERE CAST(substr(batch_id, 2) AS INT) % 3 <> 2""")
def stored_retry_and_purge(spark, sf):
    """Two uploads fail, one of them is retried; one session goes with all its tables' rows."""
    store = _store(spark)
    pipeline.ingest(_uploads(spark, sf, _CREW, "guides"), store, batch_id=F.expr(_OWN),
                    session_id=F.concat(F.lit("s"), F.expr(_NUMBER) % 3))
    batches = store.read(spark, pipeline.BATCHES).select("batch_id", "source_file")
    failed = batches.filter("batch_id IN ('C1', 'C3')")
    pipeline.fail(spark, store, failed.select(
        "batch_id", "source_file", F.lit("match").alias("stage"), F.lit("lost").alias("message")))
    pipeline.retry(spark, store, failed.filter("batch_id = 'C1'"))
    pipeline.purge(spark, store, batches.limit(1).select(F.lit("s2").alias("session_id")))
    stored = None
    for name, column in ((pipeline.CANONICAL, "stored_records"), (pipeline.ITEMS, "stored_items")):
        counts = store.read(spark, name).groupBy("batch_id").agg(F.count("*").alias(column))
        stored = counts if stored is None else stored.join(counts, "batch_id", "full")
    rows = store.read(spark, pipeline.BATCHES)
    return rows.join(stored, "batch_id", "full").select(
        "batch_id", "status", *pipeline.COUNTERS[:-1], "stored_records",
        F.coalesce("stored_items", F.lit(0)).alias("stored_items"),
        F.array_contains(F.map_keys("timings"), "matchMs").alias("timed"))


# Suppliers as files by nation: a third are sound CSV files, a third never close a quote, a third are no tables.
@query("landing_rejects", """
  SELECT CASE s_nationkey % 3 WHEN 0 THEN 'IN' WHEN 1 THEN 'FAILED' ELSE 'REJECTED' END AS what,
    count(DISTINCT s_nationkey) AS files, count(*) FILTER (s_nationkey % 3 = 0) AS records,
    CASE s_nationkey % 3 WHEN 1 THEN 'quote not closed' WHEN 2 THEN 'unsupported file' END AS reason
  FROM supplier GROUP BY s_nationkey % 3""")
def landing_rejects(spark, sf):
    """A mixed folder through the landing stream, twice: what lands, what fails and what is turned away."""
    root = f"{shared_dir(spark)}/rejects-{uuid.uuid4().hex}"
    lines = inp.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("ord"), 
        F.format_string("Guide %s,g%s@tours.example", "s_suppkey", "s_suppkey").alias("line"))
    heads = lines.select("file", F.lit(-1).alias("ord"), F.when(F.col("file") % 3 == 1, 'name,"email').otherwise("name,email").alias("line")).distinct()
    every = heads.unionByName(lines)
    for kind, wanted in (("csv", "file % 3 < 2"), ("text", "file % 3 = 2")):
        part = every.filter(wanted).repartition("file").sortWithinPartitions("file", "ord").drop("ord").write.partitionBy("file")
        (part.option("quote", "\u0000").option("sep", "\u0001") if kind == "csv" else part).format(kind).save(f"{root}/in/{kind}")
    landed = spark.read.format("binaryFile").load(f"{root}/in/*/*/part-*")
    mappings = landed.select(
        batch_of_file(F.col("path")).alias("batch_id"), F.lit(0).alias("position"),
        F.lit("GUIDE").alias("entity_type"), F.lit(None).cast("string").alias("sheet"),
        F.expr("cast(map() as map<string,string>)").alias("columns"))
    store = _store(spark)
    for _ in range(2):
        watch(spark, f"{root}/in/*/*", store, f"{root}/progress", mappings).awaitTermination()
    batches = store.read(spark, pipeline.BATCHES)
    told = batches.select(
        F.when(F.col("status") == "FAILED", "FAILED").otherwise("IN").alias("what"), "normalized",
        F.when(F.col("status") == "FAILED", F.col("error_message")).alias("reason"))
    turned = store.read(spark, pipeline.REJECTS).select(
        F.lit("REJECTED").alias("what"), F.lit(None).cast("bigint").alias("normalized"),
        F.split_part("reject_reason", F.lit(":"), F.lit(1)).alias("reason"))
    return told.unionByName(turned).groupBy("what").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("normalized"), F.lit(0)).alias("records"), F.max("reason").alias("reason"))
