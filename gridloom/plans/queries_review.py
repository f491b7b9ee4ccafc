"""Driver queries over the review queue, readiness and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import findings, normalize, publish, review
from gridloom.plans import driver_inputs as inp
from gridloom.plans.registry import query

# Review items of the guides; some are resolved already, by row number.
_ITEMS = f"""
  SELECT batch_id, ord, review_item_id, record_id, entity_type, reason, priority,
    CASE WHEN ord % 6 = 1 THEN 'RESOLVED' ELSE status END AS status,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(ord % 17 AS BIGINT)) AS created_at
  FROM ({inp.items_sql(inp.guides_sql())})"""


def _items(canonical: DataFrame, found: DataFrame) -> DataFrame:
    items = normalize.validation_items(canonical).unionByName(findings.review_items(found))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return items.withColumns({
        "status": F.when(F.col("row_ord") % 6 == 1, "RESOLVED").otherwise(F.col("status")),
        "created_at": start + F.make_dt_interval(mins=(F.col("row_ord") % 17).cast("int")),
    })


def _guide_items(spark, sf) -> DataFrame:
    return _items(*inp.guide_base(spark, sf))


# Batches: every guide batch and some that have no items.
_BATCHES = """
  SELECT DISTINCT concat('G', s_nationkey % 4) AS batch_id,
    CASE s_nationkey % 4 WHEN 0 THEN 'READY' WHEN 1 THEN 'IN_REVIEW' WHEN 2 THEN 'PREVIEWED'
      ELSE 'IN_REVIEW' END AS status FROM supplier"""


def _batches(spark, sf) -> DataFrame:
    inp.table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(_BATCHES)


@query("review_queue", f"""SELECT review_item_id, reason, priority, created_at FROM ({_ITEMS})
  WHERE status = 'OPEN' AND reason = 'DUPLICATE' AND entity_type = 'GUIDE'""")
def review_queue(spark, sf):
    chosen = review.select_items(_guide_items(spark, sf), "OPEN", "DUPLICATE", "GUIDE")
    return review.queue(chosen).select("review_item_id", "reason", "priority", "created_at")


_OPEN = ", ".join(
    f"count(*) FILTER (i.status = 'OPEN' AND i.reason = '{r}') AS open_{r.lower()}"
    for r in ("VALIDATION_ERROR", "DUPLICATE", "LOW_CONFIDENCE", "CONFLICT"))
_COUNTED = f"""SELECT b.batch_id, b.status, count(*) FILTER (i.status = 'OPEN') AS open_items, {_OPEN}
  FROM ({_BATCHES}) b LEFT JOIN ({_ITEMS}) i ON i.batch_id = b.batch_id GROUP BY b.batch_id, b.status"""


@query("readiness", f"SELECT *, open_items = 0 AS ready FROM ({_COUNTED})")
def readiness(spark, sf):
    return review.readiness(_batches(spark, sf), _guide_items(spark, sf))


@query("status_after_match", f"SELECT batch_id, CASE WHEN open_items > 0 THEN 'IN_REVIEW' ELSE 'READY' END AS status FROM ({_COUNTED})")
def status_after_match(spark, sf):
    return review.status_after_match(_batches(spark, sf), _guide_items(spark, sf))


@query("status_after_review", f"""SELECT batch_id, CASE WHEN open_items = 0 AND status = 'IN_REVIEW' THEN 'READY'
  WHEN open_items > 0 AND status = 'READY' THEN 'IN_REVIEW' ELSE status END AS status FROM ({_COUNTED})""")
def status_after_review(spark, sf):
    return review.status_after_review(_batches(spark, sf), _guide_items(spark, sf))


@query("open_review_gate", f"""SELECT batch_id, status, CASE
    WHEN open_items > 0 THEN concat('batch ', batch_id, ' has ', open_items, ' unresolved review item(s)')
    WHEN status NOT IN ('READY', 'PREVIEWED') THEN concat('batch ', batch_id, ' cannot preview from status ', status)
    END AS reject_reason FROM ({_COUNTED})""")
def open_review_gate(spark, sf):
    return publish.gate(_batches(spark, sf), "preview", _guide_items(spark, sf))


# -- decisions: the event log taken as decisions on the guides' items --------------------------

_DECISION_COLUMNS = """
    event_id AS decision_id,
    concat('G', n % 3, ':0:', user_id, CASE event_id % 4 WHEN 0 THEN ':LOW_CONFIDENCE' WHEN 1 THEN ':NOTHING'
      ELSE ':DUPLICATE' END) AS review_item_id,
    CASE event_type WHEN 'click' THEN 'ACCEPT' WHEN 'view' THEN 'REJECT' WHEN 'purchase' THEN 'MERGE'
      WHEN 'signup' THEN 'EDIT' ELSE 'REMAP' END AS resolution,
    concat('user', user_id) AS resolved_by, ts AS decided_at,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN concat('rec', event_id) END AS target_record_id,
    CASE WHEN event_type = 'error' THEN concat('ext', event_id) END AS target_external_id"""
# A decision names the row with the user's number in the batch that supplier is in; a user who is no
# supplier names a row that isn't there.
_LOG = "(SELECT e.*, coalesce(s_nationkey, 0) AS n FROM events e LEFT JOIN supplier ON s_suppkey = user_id) AS log"
_DECISIONS = f"SELECT {_DECISION_COLUMNS}, concat('Guide ', event_id) AS new_name FROM {_LOG}"


def _decisions(spark, sf) -> DataFrame:
    inp.table(spark, sf, "events").createOrReplaceTempView("events")
    inp.table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    fields = ("CASE WHEN event_type = 'signup' THEN map('fullName', concat('Guide ', event_id),"
              " 'email', concat('NEW', event_id, '@Tours.example'), 'unknown', 'x') END AS fields")
    return spark.sql(f"SELECT {_DECISION_COLUMNS}, {fields} FROM {_LOG}")


_RULED = f"""
  WITH items AS ({_ITEMS}), d AS ({_DECISIONS}),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY review_item_id ORDER BY decided_at, decision_id) AS nth FROM d),
  ruled AS (SELECT n.*, i.record_id, i.batch_id, CASE WHEN i.record_id IS NULL THEN 'not_found'
      WHEN i.status <> 'OPEN' THEN 'not_open' WHEN nth > 1 THEN 'not_open' END AS reject_reason
    FROM numbered n LEFT JOIN items i USING (review_item_id)),
  applied AS (SELECT * FROM ruled WHERE reject_reason IS NULL),
  edits AS (SELECT record_id, arg_max(decision_id, decided_at) AS edit_id FROM applied WHERE resolution = 'EDIT' GROUP BY record_id),
  spoken AS (SELECT record_id, arg_max(CASE resolution WHEN 'REJECT' THEN 'REJECTED' ELSE 'CONFIRMED' END, decided_at) AS st
    FROM applied WHERE resolution <> 'EDIT' GROUP BY record_id),
  remaps AS (SELECT record_id, arg_max(target_external_id, decided_at) AS ext,
      arg_max(target_record_id, decided_at) FILTER (target_record_id IS NOT NULL) AS rec
    FROM applied WHERE resolution = 'REMAP' GROUP BY record_id)"""


def _decided(spark, sf, base: tuple[DataFrame, DataFrame] | None = None) -> review.Decided:
    canonical, found = base or inp.guide_base(spark, sf)
    items = _items(canonical, found)
    return review.decide(canonical, findings.match_candidates(found), items, _decisions(spark, sf))


@query("decided_records", _RULED + f"""
  SELECT g.record_id, CASE WHEN edit_id IS NULL THEN full_name ELSE concat('Guide ', edit_id) END AS full_name,
    CASE WHEN edit_id IS NULL THEN email ELSE concat('NEW', edit_id, '@Tours.example') END AS email,
    CASE WHEN edit_id IS NULL THEN key_name ELSE concat('guide ', edit_id) END AS key_name,
    CASE WHEN edit_id IS NULL THEN key_email ELSE concat('new', edit_id, '@tours.example') END AS key_email,
    CASE WHEN g.record_id IN (SELECT record_id FROM applied) THEN 'REVIEWED' ELSE 'DRAFT' END AS status
  FROM ({inp.guides_sql()}) g LEFT JOIN edits USING (record_id)""")
def decided_records(spark, sf):
    return _decided(spark, sf).canonical.select(
        "record_id", F.col("data.fullName").alias("full_name"), F.col("data.email").alias("email"),
        "key_name", "key_email", "status")


@query("decided_candidates", _RULED + f"""
  SELECT candidate_id, coalesce(st, status) AS status, coalesce(rec, target_record_id) AS target_record_id,
    ext AS target_external_id, target_kind
  FROM ({inp.candidates_sql(inp.guides_sql())}) LEFT JOIN spoken USING (record_id) LEFT JOIN remaps USING (record_id)""")
def decided_candidates(spark, sf):
    return _decided(spark, sf).candidates.select(
        "candidate_id", "status", "target_record_id", "target_external_id", "target_kind")


@query("decided_items", _RULED + """
  SELECT i.review_item_id, CASE WHEN a.resolution IS NULL THEN i.status ELSE 'RESOLVED' END AS status, a.resolution,
    a.resolved_by FROM items i LEFT JOIN applied a USING (review_item_id)""")
def decided_items(spark, sf):
    return _decided(spark, sf).items.select("review_item_id", "status", "resolution", "resolved_by")


@query("review_events", _RULED + """
  SELECT review_item_id, batch_id, resolution AS action, 'OPEN' AS from_status, 'RESOLVED' AS to_status,
    resolved_by AS actor, decided_at AS created_at FROM applied""")
def review_events(spark, sf):
    return _decided(spark, sf).events.drop("event_id")


@query("rejected_decisions", _RULED + " SELECT decision_id, reject_reason FROM ruled WHERE reject_reason IS NOT NULL")
def rejected_decisions(spark, sf):
    return _decided(spark, sf).rejects.select("decision_id", "reject_reason")
