"""Driver queries over batches: lists, counters, failures, purge, timeline and landing files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.lineage import shared_dir
from gridloom.operators import batches, paging
from gridloom.plans import driver_inputs as inp
from gridloom.plans import queries_publish as qp
from gridloom.plans import queries_review as qr
from gridloom.sources.store import Store
from gridloom.plans.registry import query
from gridloom.sources.csv_files import batch_of_file, read_csv
from gridloom.streaming.landing import watch_csv

_PAGE = "SELECT concat('o', o_orderkey) AS id, o_orderdate AS created_at, o_orderstatus FROM orders"


def _page_rows(spark, sf) -> DataFrame:
    inp.table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(_PAGE)


@query("first_page", f"""SELECT id, created_at, (SELECT id FROM ({_PAGE}) ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET 49)
  AS next_cursor FROM ({_PAGE}) ORDER BY created_at DESC, id DESC LIMIT 50""")
def first_page(spark, sf):
    return paging.page(_page_rows(spark, sf)).select("id", "created_at", "next_cursor")


@query("later_page", f"""
  WITH o AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM ({_PAGE})),
  c AS (SELECT n FROM o WHERE id = 'o77')
  SELECT id, created_at, (SELECT id FROM o WHERE n = (SELECT n FROM c) + 200 AND (SELECT max(n) FROM o) > (SELECT n FROM c) + 200)
    AS next_cursor FROM o WHERE n > (SELECT n FROM c) AND n <= (SELECT n FROM c) + 200""")
def later_page(spark, sf):
    return paging.page(_page_rows(spark, sf), limit=200, cursor="o77").select("id", "created_at", "next_cursor")


@query("sessions_newest_first", "SELECT c_custkey, created_at FROM (SELECT o_custkey AS c_custkey,"
       " min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey)")
def sessions_newest_first(spark, sf):
    sessions = inp.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("created_at"))
    return batches.newest_first(sessions)


@query("batches_by_status", f"SELECT batch_id, session_id FROM ({qp._STATES}) WHERE status = 'FAILED'")
def batches_by_status(spark, sf):
    return batches.with_status(qp._states(spark, sf), "FAILED").select("batch_id", "session_id")


@query("batch_detail", """
  SELECT concat('o', o_orderkey) AS batch_id, c_name AS original_filename, concat('sha', o_orderkey) AS content_hash,
    count(l_orderkey) AS extracted_records
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, c_name""")
def batch_detail(spark, sf):
    orders = inp.table(spark, sf, "orders")
    rows = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("batch_id"), F.col("o_custkey").alias("source_id"))
    sources = inp.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("source_id"), F.col("c_name").alias("original_filename"))
    artifacts = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("batch_id"),
                              F.concat(F.lit("sha"), "o_orderkey").alias("content_hash"))
    extracted = inp.table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("batch_id"))
    return batches.detail(rows, sources, artifacts, extracted).select(
        "batch_id", "original_filename", "content_hash", "extracted_records")


_ERRORS = f"""SELECT batch_id, status, CASE WHEN status = 'FAILED' THEN 'normalize' END AS error_stage,
  CASE WHEN status = 'FAILED' THEN 'boom' END AS error_message FROM ({qp._STATES})"""


def _with_errors(spark, sf) -> DataFrame:
    failed = F.col("status") == "FAILED"
    return qp._states(spark, sf).select(
        "batch_id", "status", F.when(failed, "normalize").alias("error_stage"),
        F.when(failed, "boom").alias("error_message"))


@query("retried_batches", f"""
  SELECT b.batch_id, CASE WHEN bad THEN b.status ELSE 'EXTRACTED' END AS status,
    CASE WHEN bad THEN error_stage END AS error_stage, CASE WHEN bad THEN error_message END AS error_message,
    CASE WHEN bad THEN 'batch has committed actions' END AS reject_reason
  FROM ({_ERRORS}) b JOIN (SELECT concat('o', o_orderkey) AS batch_id, o_orderkey IN (SELECT l_orderkey FROM lineitem
      WHERE l_returnflag = 'R') AS bad FROM orders) x USING (batch_id)""")
def retried_batches(spark, sf):
    """Line items stand in for actions; returned ones count as committed."""
    actions = inp.table(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey").alias("batch_id"),
        F.when(F.col("l_returnflag") == "R", "COMMITTED").otherwise("PLANNED").alias("status"))
    return batches.retry(_with_errors(spark, sf), actions)


@query("failed_batches", f"""
  SELECT batch_id, CASE WHEN k % 5 = 0 THEN 'FAILED' ELSE status END AS status,
    CASE WHEN k % 5 = 0 THEN 'match' ELSE error_stage END AS error_stage,
    CASE WHEN k % 5 = 0 THEN concat('no ', k) ELSE error_message END AS error_message
  FROM (SELECT *, CAST(substr(batch_id, 2) AS BIGINT) AS k FROM ({_ERRORS}))""")
def failed_batches(spark, sf):
    key = F.substring("batch_id", 2, 20).cast("bigint")
    rows = _with_errors(spark, sf)
    failures = rows.filter(key % 5 == 0).select(
        "batch_id", F.lit("match").alias("stage"), F.concat(F.lit("no "), key).alias("message"))
    return batches.mark_failed(rows, failures)


@query("merged_counts", """
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 7 END AS total_rows,
    CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 END AS duplicates,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 5 END AS normalize_ms, o_custkey AS match_ms FROM orders""")
def merged_counts(spark, sf):
    inp.table(spark, sf, "orders").createOrReplaceTempView("orders")
    rows = spark.sql("""
      SELECT o_orderkey,
        named_struct('total_rows', 7L, 'duplicates', CAST(NULL AS BIGINT), 'timings', map('normalizeMs', 5L)) AS base,
        named_struct('total_rows', CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END,
          'duplicates', CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 END,
          'timings', CASE WHEN o_orderkey % 2 = 0 THEN map('normalizeMs', o_orderkey, 'matchMs', o_custkey)
            ELSE map('matchMs', o_custkey) END) AS patch FROM orders""")
    merged = batches.merge_counts(F.col("base"), F.col("patch"), ("total_rows", "duplicates", "timings"))
    return rows.withColumn("m", merged).select(
        "o_orderkey", "m.total_rows", "m.duplicates",
        F.try_element_at("m.timings", F.lit("normalizeMs")).alias("normalize_ms"),
        F.try_element_at("m.timings", F.lit("matchMs")).alias("match_ms"))


@query("purged_sessions", """
  SELECT 'sources' AS tab, concat('src', c_custkey) AS id FROM customer WHERE c_custkey % 10 <> 3
  UNION ALL SELECT 'batches', concat('o', o_orderkey) FROM orders WHERE o_custkey % 10 <> 3
  UNION ALL SELECT 'publish_actions', concat('a', l_orderkey, '-', l_linenumber) FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 10 <> 3""")
def purged_sessions(spark, sf):
    """Customers stand for sessions, orders for batches, line items for actions."""
    customers, orders = inp.table(spark, sf, "customer"), inp.table(spark, sf, "orders")
    tables = {
        "sources": customers.select(F.concat(F.lit("src"), "c_custkey").alias("id"), F.col("c_custkey").alias("session_id")),
        "batches": orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"),
                                 F.concat(F.lit("o"), "o_orderkey").alias("batch_id"), F.col("o_custkey").alias("session_id")),
        "publish_actions": inp.table(spark, sf, "lineitem").select(
            F.concat(F.lit("a"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"),
            F.concat(F.lit("o"), "l_orderkey").alias("batch_id")),
    }
    gone = customers.filter("c_custkey % 10 = 3").select(F.col("c_custkey").alias("session_id"))
    left = batches.purge_sessions(tables, gone)
    out = None
    for name, rows in left.items():
        part = rows.select(F.lit(name).alias("tab"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("cleared_references", """
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderstatus <> 'F' THEN l_orderkey END AS source_record_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def cleared_references(spark, sf):
    """References to removed parents become null."""
    rows = inp.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("source_record_id"))
    parents = inp.table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey")
    return batches.clear_lost(rows, "source_record_id", parents, "o_orderkey")


@query("timeline", f"""
  {qr._RULED}, acts AS (SELECT * FROM ({qp._PLAN}))
  SELECT batch_id, 0 AS part, 'batch' AS kind, TIMESTAMP '2024-02-01 00:00:00' AS at, CAST(NULL AS BIGINT) AS sequence,
    status AS label, batch_id AS ref_id FROM ({qr._BATCHES})
  UNION ALL SELECT b.batch_id, 1, 'readiness', NULL, NULL, concat(count(*) FILTER (i.status = 'OPEN'), ' open'), b.batch_id
    FROM ({qr._BATCHES}) b LEFT JOIN items i ON i.batch_id = b.batch_id GROUP BY b.batch_id
  UNION ALL SELECT batch_id, 2, 'review', decided_at, NULL, resolution, review_item_id FROM applied
  UNION ALL SELECT batch_id, 3, 'action', NULL, sequence, concat(op, ' ', status), action_id FROM acts""")
def timeline(spark, sf):
    shown = qr._batches(spark, sf).withColumn("updated_at", F.lit("2024-02-01").cast("timestamp_ntz"))
    base = inp.guide_base(spark, sf)
    items = qr._items(*base)
    events = qr._decided(spark, sf, base).events
    actions = qp._planned(spark, sf, base)[1]
    return batches.timeline_order(batches.timeline(shown, items, events, actions))


# Files of at most a thousand guides each; a file is a batch.
_FILE = "concat(batch_id, '-', CAST(floor(ord / 1000) AS BIGINT))"
_LANDED = inp.guides_sql().replace("SELECT batch_id, ord,", f"SELECT {_FILE} AS batch_id, ord,", 1)


@query("landed_files", f"""
  SELECT 'GUIDE' AS what, count(*) AS n, count(*) FILTER (errors <> '') AS invalid, count(DISTINCT batch_id) AS batches
    FROM ({_LANDED})
  UNION ALL SELECT strategy, count(*), 0, count(DISTINCT batch_id) FROM ({inp.findings_sql(_LANDED)}) GROUP BY strategy""")
def landed_files(spark, sf):
    """The guides written as CSV files and taken in by the landing stream."""
    root = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    columns = [F.expr(e).alias(h) for h, e in inp.GUIDES.cells.items()]
    rows = inp.raw_frame(spark, sf, inp.GUIDES).select(
        F.expr(inp.GUIDES.batch).alias("batch_id"), F.expr(inp.GUIDES.row).alias("ord"), *columns)
    files = rows.withColumn("file", F.expr(_FILE)).drop("batch_id")
    (files.repartition("file").sortWithinPartitions("file", "ord").drop("ord")
     .write.partitionBy("file").option("header", "true").csv(f"{root}/in"))
    # The part files' names say nothing about the entity, so each gets an unscoped mapping.
    landed = spark.read.format("binaryFile").load(f"{root}/in/*/*.csv")
    mappings = landed.select(
        batch_of_file(F.col("path")).alias("batch_id"), F.lit(0).alias("position"),
        F.lit("GUIDE").alias("entity_type"), F.lit(None).cast("string").alias("sheet"),
        F.expr("cast(map() as map<string,string>)").alias("columns"))
    store = Store(f"{root}/store")
    watch_csv(spark, f"{root}/in/*", store, f"{root}/progress", mappings).awaitTermination()
    records = store.read(spark, "canonical").groupBy(F.col("entity_type").alias("what")).agg(
        F.count("*").alias("n"), F.count_if(F.size("validation_errors") > 0).alias("invalid"),
        F.countDistinct("batch_id").alias("batches"))
    pairs = store.read(spark, "match_candidates").groupBy(F.col("strategy").alias("what")).agg(
        F.count("*").alias("n"), F.lit(0).cast("bigint").alias("invalid"),
        F.countDistinct("batch_id").alias("batches"))
    return records.unionByName(pairs)


# A line per supplier: empty cells at the start, in the middle and at the end, nothing but empty cells,
# rows too short and too long, blank lines, line breaks, commas and quotes inside quotes.
_CSV_LINE = """CASE s_suppkey % 9 WHEN 0 THEN concat('s', s_suppkey, ',,', s_suppkey) WHEN 1 THEN concat(',n', s_suppkey, ', 1 ')
    WHEN 2 THEN concat('s', s_suppkey, ',n,') WHEN 3 THEN ',,' WHEN 4 THEN concat('s', s_suppkey)
    WHEN 5 THEN concat('s', s_suppkey, ',n,1,beyond') WHEN 6 THEN concat(chr(10), '   ', chr(10), 's,n,', s_suppkey)
    WHEN 7 THEN concat('"two', chr(10), 'lines', s_suppkey, '",,') ELSE concat('"a ""b"", ', s_suppkey, '",n,""') END"""
_CSV_CELLS = """CASE s_suppkey % 9 WHEN 0 THEN ['s' || s_suppkey, '', s_suppkey::VARCHAR] WHEN 1 THEN ['', 'n' || s_suppkey, '1']
    WHEN 2 THEN ['s' || s_suppkey, 'n', ''] WHEN 3 THEN ['', '', ''] WHEN 4 THEN ['s' || s_suppkey, NULL, NULL]
    WHEN 5 THEN ['s' || s_suppkey, 'n', '1'] WHEN 6 THEN ['s', 'n', s_suppkey::VARCHAR]
    WHEN 7 THEN ['two' || chr(10) || 'lines' || s_suppkey, '', ''] ELSE ['a "b", ' || s_suppkey, 'n', ''] END"""


@query("csv_cells", f"""
  SELECT file, source_row_index, unnest(['sku', 'name', 'price']) AS header, unnest(cells) AS value
  FROM (SELECT s_nationkey::BIGINT AS file, {_CSV_CELLS} AS cells,
               row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS source_row_index FROM supplier)""")
def csv_cells(spark, sf):
    """The suppliers written as raw CSV text and read back cell by cell."""
    root = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    lines = inp.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("ord"), F.expr(_CSV_LINE).alias("line"))
    heads = lines.select("file", F.lit(-1).alias("ord"), F.lit("sku,name,price").alias("line")).distinct()
    (heads.unionByName(lines).repartition("file").sortWithinPartitions("file", "ord").drop("ord")
     .write.partitionBy("file").text(root))
    rows = read_csv(spark, f"{root}/*/*.txt")
    return rows.select(
        F.regexp_extract("source_file", "file=([0-9]+)", 1).cast("bigint").alias("file"), "source_row_index",
        F.inline("cells"))
