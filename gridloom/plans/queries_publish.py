"""Driver queries over publish plans, outcomes, rollbacks and the import contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.publishing import external_id
from gridloom.lineage import materialize
from gridloom.operators import contract, findings, ledger, publish, references
from gridloom.plans import driver_inputs as inp
from gridloom.plans.registry import query

# Guide duplicates, every second one confirmed; some guides match an existing entity.
_CANDIDATES = f"""
  SELECT record_id, target_kind, CAST(NULL AS VARCHAR) AS target_external_id,
    CASE WHEN ord % 2 = 0 THEN 'CONFIRMED' ELSE 'CANDIDATE' END AS status
  FROM ({inp.candidates_sql(inp.guides_sql())})
  UNION ALL SELECT record_id, 'EXISTING_PLATFORM', concat('plat-', ord), 'CONFIRMED'
  FROM ({inp.guides_sql()}) WHERE ord % 7 = 3"""
_PLAN = f"""
  SELECT *, concat(record_id, ':', op) AS action_id, concat(batch_id, ':', record_id, ':', op) AS idempotency_key,
    'PLANNED' AS status, row_number() OVER (PARTITION BY batch_id ORDER BY ord) - 1 AS sequence
  FROM (SELECT g.*, t.ext AS target_external_id, CASE WHEN t.ext IS NULL THEN 'CREATE' ELSE 'UPDATE' END AS op
    FROM ({inp.guides_sql()}) g LEFT JOIN (SELECT record_id,
        bool_or(target_kind = 'INTRA_BATCH') AS merged, min(target_external_id) AS ext
      FROM ({_CANDIDATES}) WHERE status = 'CONFIRMED' GROUP BY record_id) t USING (record_id)
    WHERE NOT coalesce(t.merged, false))"""


def _guides(spark, sf) -> DataFrame:
    return materialize(inp.canonical(spark, sf, inp.GUIDES))


def _candidates(canonical: DataFrame, found: DataFrame) -> DataFrame:
    own = findings.match_candidates(found)
    ord_ = F.split_part("record_id", F.lit(":"), F.lit(3)).cast("bigint")
    own = own.withColumn("status", F.when(ord_ % 2 == 0, "CONFIRMED").otherwise(F.col("status")))
    known = canonical.filter("row_ord % 7 = 3").select(
        "record_id", F.lit("EXISTING_PLATFORM").alias("target_kind"),
        F.concat(F.lit("plat-"), "row_ord").alias("target_external_id"), F.lit("CONFIRMED").alias("status"))
    return own.unionByName(known, allowMissingColumns=True)


def _planned(spark, sf, base: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    canonical, found = base or inp.guide_base(spark, sf)
    return canonical, publish.plan(canonical, _candidates(canonical, found))


@query("publish_plan", f"SELECT action_id, record_id, op, status, sequence, target_external_id, idempotency_key FROM ({_PLAN})")
def publish_plan(spark, sf):
    return _planned(spark, sf)[1].select(
        "action_id", "record_id", "op", "status", "sequence", "target_external_id", "idempotency_key")


@query("plan_of_orders", f"""
  SELECT record_id, row_number() OVER (PARTITION BY batch_id ORDER BY ord) - 1 AS sequence
  FROM ({inp.bookings_sql()})""")
def plan_of_orders(spark, sf):
    """Sequence numbers over large batches, numbered chunk by chunk."""
    return publish.number_rows(inp.canonical(spark, sf, inp.BOOKINGS).select(
        "batch_id", "row_ord", "record_id")).select("record_id", "sequence")


@query("payloads", f"""
  SELECT record_id, json_extract_string(payload, '$.name') AS name, CAST(json_extract_string(payload, '$.price') AS DOUBLE) AS price,
    json_array_length(json_keys(payload)) AS fields FROM (SELECT record_id, json_merge_patch('{{}}',
      json_object('name', name, 'sku', sku, 'category', category, 'price', price, 'currency', currency)) AS payload
    FROM ({inp.products_sql()}))""")
def payloads(spark, sf):
    """Payload JSON leaves absent fields out; read back here field by field."""
    from gridloom.functions.publishing import payload_json

    body = inp.canonical(spark, sf, inp.PRODUCTS).select("record_id", payload_json(F.col("data")).alias("payload"))
    return body.select(
        "record_id", F.get_json_object("payload", "$.name").alias("name"),
        F.get_json_object("payload", "$.price").cast("double").alias("price"),
        F.size(F.json_object_keys("payload")).cast("bigint").alias("fields"))


_SUMMARY = ", ".join(
    [f"count(*) FILTER (op = '{o}') AS op_{o.lower()}" for o in ("CREATE", "UPDATE", "LINK", "DEACTIVATE")]
    + [f"count(*) FILTER (status = '{s}') AS status_{s.lower()}" for s in ("PLANNED", "COMMITTED", "FAILED", "ROLLED_BACK")])


@query("plan_summary", f"SELECT batch_id, count(*) AS total, {_SUMMARY} FROM ({_PLAN}) GROUP BY batch_id")
def plan_summary(spark, sf):
    return publish.plan_summary(_planned(spark, sf)[1])


_EXT = "concat('ext_', lower(entity_type), '_', left(sha1(idempotency_key), 16))"


@query("external_ids", f"SELECT record_id, coalesce(target_external_id, {_EXT}) AS external_id FROM ({_PLAN})")
def external_ids(spark, sf):
    return _planned(spark, sf)[1].select("record_id", external_id(
        F.col("target_external_id"), F.col("entity_type"), F.col("idempotency_key")).alias("external_id"))


# -- states -----------------------------------------------------------------------------------

_STATES = """
  SELECT concat('o', o_orderkey) AS batch_id, concat('s', o_custkey) AS session_id,
    CASE o_orderkey % 8 WHEN 0 THEN 'READY' WHEN 1 THEN 'PREVIEWED' WHEN 2 THEN 'COMMITTING'
      WHEN 3 THEN 'COMMITTED' WHEN 4 THEN 'FAILED' WHEN 5 THEN 'ROLLING_BACK' WHEN 6 THEN 'IN_REVIEW'
      ELSE 'COMMITTED' END AS status, o_orderdate AS updated_at, o_orderkey FROM orders"""


def _states(spark, sf) -> DataFrame:
    inp.table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(_STATES)


def _gate_sql(step: str, allowed: str) -> str:
    return (f"SELECT '{step}' AS step, batch_id, CASE WHEN status NOT IN ({allowed}) THEN"
            f" concat('batch ', batch_id, ' cannot {step} from status ', status) END AS reject_reason FROM ({_STATES})")


@query("state_gate", " UNION ALL ".join((
    _gate_sql("preview", "'READY','PREVIEWED'"),
    _gate_sql("commit", "'READY','PREVIEWED','COMMITTING','COMMITTED','FAILED'"),
    _gate_sql("rollback", "'COMMITTED','FAILED','ROLLING_BACK'"))))
def state_gate(spark, sf):
    states, out = _states(spark, sf), None
    for step in ("preview", "commit", "rollback"):
        rows = publish.gate(states, step).select(F.lit(step).alias("step"), "batch_id", "reject_reason")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("rollback_latest", f"""
  SELECT concat('s', c_custkey) AS session_id, l.batch_id, l.updated_at,
    CASE WHEN l.batch_id IS NULL THEN concat('session s', c_custkey, ' has no committed batch to roll back') END AS error
  FROM customer LEFT JOIN (SELECT session_id, batch_id, updated_at, row_number() OVER (PARTITION BY session_id
      ORDER BY updated_at DESC, batch_id DESC) AS rn FROM ({_STATES}) WHERE status = 'COMMITTED') l
    ON l.session_id = concat('s', c_custkey) AND l.rn = 1""")
def rollback_latest(spark, sf):
    sessions = inp.table(spark, sf, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("session_id"))
    return ledger.latest_committed(_states(spark, sf), sessions)


# -- outcomes ---------------------------------------------------------------------------------

# Bookings as planned actions. In the urgent batch one action fails, in the high one none, in the medium one several,
# in the unspecified one some were committed before and the sender stopped halfway, in the low one nothing was sent.
_ACTIONS = f"""
  SELECT batch_id, ord, record_id, 'BOOKING' AS entity_type, 'CREATE' AS op,
    concat(record_id, ':CREATE') AS action_id, concat(batch_id, ':', record_id, ':CREATE') AS idempotency_key,
    row_number() OVER (PARTITION BY batch_id ORDER BY ord) - 1 AS sequence,
    CASE WHEN batch_id = 'B4-NOT SPECIFIED' AND ord % 3 = 0 THEN 'COMMITTED' WHEN batch_id = 'B3-MEDIUM' AND ord % 5 = 0 THEN 'FAILED'
      ELSE 'PLANNED' END AS status,
    CASE WHEN batch_id = 'B4-NOT SPECIFIED' AND ord % 3 = 0 THEN concat('old-', ord) END AS result_external_id,
    CASE WHEN batch_id = 'B3-MEDIUM' AND ord % 5 = 0 THEN 'earlier' END AS error
  FROM ({inp.bookings_sql()})"""
_SENT = "((batch_id IN ('B1-URGENT','B2-HIGH','B3-MEDIUM') OR (batch_id = 'B4-NOT SPECIFIED' AND ord % 100 < 50)) AND status IN ('PLANNED','FAILED'))"
_BAD = "((batch_id = 'B1-URGENT' AND ord % 1000 > 990) OR (batch_id = 'B3-MEDIUM' AND ord % 700 > 690))"
_EXTERNAL = "CASE WHEN ord % 4 = 0 THEN concat('given-', ord) END"
_AFTER = f"""
  WITH a AS (SELECT *, {_SENT} AS sent, {_BAD} AS bad FROM ({_ACTIONS})),
  stops AS (SELECT batch_id, min(sequence) FILTER (sent AND bad) AS stop FROM a GROUP BY batch_id),
  j AS (SELECT a.*, sent AND (stop IS NULL OR sequence <= stop) AS reached FROM a JOIN stops USING (batch_id)),
  after AS (SELECT batch_id, ord, record_id, action_id, sequence, op,
    CASE WHEN reached AND NOT bad THEN 'COMMITTED' WHEN reached THEN 'FAILED' ELSE status END AS status,
    CASE WHEN reached AND NOT bad THEN coalesce({_EXTERNAL}, concat('ext_booking_', left(sha1(idempotency_key), 16)))
      ELSE result_external_id END AS result_external_id,
    CASE WHEN reached AND bad THEN concat('boom ', ord) WHEN reached THEN NULL ELSE error END AS error FROM j)"""


def _ledger(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Booking records, their actions before sending, and what the sender reports."""
    canonical = materialize(inp.canonical(spark, sf, inp.BOOKINGS))
    none = spark.createDataFrame(
        [], "record_id string, target_kind string, target_external_id string, status string")
    ord_ = F.split_part("record_id", F.lit(":"), F.lit(3)).cast("bigint")
    old = (F.col("batch_id") == "B4-NOT SPECIFIED") & (ord_ % 3 == 0)
    failed = (F.col("batch_id") == "B3-MEDIUM") & (ord_ % 5 == 0)
    actions = materialize(publish.plan(canonical, none).withColumns({
        "ord": ord_,
        "status": F.when(old, "COMMITTED").when(failed, "FAILED").otherwise(F.col("status")),
        "result_external_id": F.when(old, F.concat(F.lit("old-"), ord_)),
        "error": F.when(failed, "earlier"),
    }))
    outcomes = actions.filter(_SENT).select(
        "action_id", (~F.expr(_BAD)).alias("ok"), F.expr(_EXTERNAL).alias("external_id"),
        F.expr(f"CASE WHEN {_BAD} THEN concat('boom ', ord) END").alias("error"))
    return canonical, actions.drop("ord"), outcomes


def _batches_of(actions: DataFrame) -> DataFrame:
    return actions.select("batch_id").distinct().withColumn("status", F.lit("PREVIEWED"))


@query("work_set", f"SELECT action_id, sequence FROM ({_ACTIONS}) WHERE status IN ('PLANNED', 'FAILED')")
def work_set(spark, sf):
    return publish.work_set(_ledger(spark, sf)[1]).select("action_id", "sequence")


# batches of every order priority, and as many more that nobody planned
_ASKED = ("CASE c_custkey % 9 WHEN 1 THEN 'B1-URGENT' WHEN 2 THEN 'B2-HIGH' WHEN 3 THEN 'B3-MEDIUM'"
          " WHEN 4 THEN 'B4-NOT SPECIFIED' WHEN 5 THEN 'B5-LOW' ELSE concat('B', c_custkey % 9) END")


@query("unplanned_batches", f"""SELECT DISTINCT {_ASKED} AS batch_id FROM customer
  WHERE {_ASKED} NOT IN (SELECT batch_id FROM ({_ACTIONS}))""")
def unplanned_batches(spark, sf):
    batches = inp.table(spark, sf, "customer").select(F.expr(_ASKED).alias("batch_id")).distinct()
    return publish.unplanned(batches, _ledger(spark, sf)[1])


@query("commit_ledger", _AFTER + " SELECT action_id, status, sequence, result_external_id, error FROM after")
def commit_ledger(spark, sf):
    _, actions, outcomes = _ledger(spark, sf)
    return ledger.reconcile(actions, outcomes).select("action_id", "status", "sequence", "result_external_id", "error")


# besides the bookings' batches: empty ones that were asked for, and one that was rolled back as a whole
@query("committed_batches", _AFTER + """
  SELECT batch_id, CASE WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'FAILED'
      WHEN count(*) FILTER (status = 'COMMITTED') = 0 THEN 'PREVIEWED'
      WHEN count(*) FILTER (status = 'PLANNED') > 0 THEN 'COMMITTING' ELSE 'COMMITTED' END AS status,
    CASE WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'commit' END AS error_stage,
    arg_min(action_id, sequence) FILTER (status = 'FAILED') AS error_action_id,
    arg_min(error, sequence) FILTER (status = 'FAILED') AS error_message FROM after GROUP BY batch_id
  UNION ALL SELECT DISTINCT concat('E', o_orderstatus), 'COMMITTED', NULL, NULL, NULL FROM orders
  UNION ALL SELECT DISTINCT 'X', 'ROLLED_BACK', NULL, NULL, NULL FROM after WHERE batch_id = 'B5-LOW'""")
def committed_batches(spark, sf):
    canonical, actions, outcomes = _ledger(spark, sf)
    undone = actions.filter("batch_id = 'B5-LOW'").withColumns({
        "batch_id": F.lit("X"), "status": F.lit("ROLLED_BACK"), "action_id": F.concat(F.lit("x"), "action_id")})
    empty = inp.table(spark, sf, "orders").select(F.concat(F.lit("E"), "o_orderstatus").alias("batch_id")).distinct()
    rows = _batches_of(actions).unionByName(empty.withColumn("status", F.lit("PREVIEWED"))).unionByName(
        undone.select("batch_id").distinct().withColumn("status", F.lit("ROLLED_BACK")))
    asked = rows.filter("batch_id <> 'B5-LOW'")
    return ledger.commit(actions.unionByName(undone), canonical, rows, outcomes, asked).batches


@query("published_records", _AFTER + """
  SELECT record_id, CASE WHEN status = 'COMMITTED' THEN 'PUBLISHED' ELSE 'DRAFT' END AS status,
    CASE WHEN status = 'COMMITTED' THEN result_external_id END AS external_id FROM after""")
def published_records(spark, sf):
    canonical, actions, outcomes = _ledger(spark, sf)
    return ledger.commit(actions, canonical, _batches_of(actions), outcomes).canonical.select(
        "record_id", "status", "external_id")


def _rolled(spark, sf) -> ledger.Ledger:
    canonical, actions, outcomes = _ledger(spark, sf)
    done = materialize(ledger.reconcile(actions, outcomes))
    return ledger.rollback(done, ledger.publish_records(canonical, done), _batches_of(actions))


@query("rollback_plan", _AFTER + """
  SELECT action_id, CASE WHEN status = 'COMMITTED' THEN 'ROLLED_BACK' ELSE status END AS status, op, sequence,
    CAST(NULL AS VARCHAR) AS target_external_id, CAST(NULL AS VARCHAR) AS compensation_of FROM after
  UNION ALL SELECT concat(record_id, ':DEACTIVATE'), 'ROLLED_BACK', 'DEACTIVATE', sequence, result_external_id, action_id
  FROM after WHERE status = 'COMMITTED'""")
def rollback_plan(spark, sf):
    return ledger.rollback_order(_rolled(spark, sf).actions).select(
        "action_id", "status", "op", "sequence", "target_external_id", "compensation_of")


@query("rolled_back_records", _AFTER + """
  SELECT record_id, CASE WHEN status = 'COMMITTED' THEN 'REVIEWED' ELSE 'DRAFT' END AS status,
    CAST(NULL AS VARCHAR) AS external_id FROM after""")
def rolled_back_records(spark, sf):
    return _rolled(spark, sf).canonical.select("record_id", "status", "external_id")


@query("reversed_actions", _AFTER + """
  SELECT concat(record_id, ':DEACTIVATE') AS action_id, action_id AS compensation_of, op AS original_op,
    'ROLLED_BACK' AS original_status, result_external_id AS original_external_id FROM after WHERE status = 'COMMITTED'""")
def reversed_actions(spark, sf):
    return ledger.with_reversed(_rolled(spark, sf).actions).select(
        "action_id", "compensation_of", "original_op", "original_status", "original_external_id")


@query("action_log", f"SELECT action_id, batch_id, sequence FROM ({_ACTIONS})")
def action_log(spark, sf):
    made = F.lit("2024-01-01").cast("timestamp_ntz")
    return publish.action_log(_ledger(spark, sf)[1].withColumn("created_at", made)).select(
        "action_id", "batch_id", "sequence")


# -- the import contract ------------------------------------------------------------------------

_REQUESTS = """
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'LINK'
      WHEN 3 THEN 'DEACTIVATE' WHEN 4 THEN 'DROP' ELSE NULL END AS op,
    CASE event_type WHEN 'click' THEN 'PRODUCT' WHEN 'view' THEN 'BOOKING' WHEN 'error' THEN 'HOTEL' ELSE 'GUIDE' END AS entity_type,
    CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('e', user_id) END AS external_id,
    CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('k', user_id) END AS idempotency_key,
    CASE event_id % 6 WHEN 4 THEN 'DROP' ELSE 'CREATE' END AS original_op FROM events"""


def _requests(spark, sf) -> DataFrame:
    inp.table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(_REQUESTS)


@query("request_errors", f"""
  SELECT event_id, concat_ws('|',
    CASE WHEN op IS NULL OR op = 'DROP' THEN 'op: not a publish operation' END,
    CASE WHEN entity_type = 'HOTEL' THEN 'entityType: not an entity type' END,
    CASE WHEN external_id = '' THEN 'externalId: must not be empty' END,
    CASE WHEN coalesce(idempotency_key, '') = '' THEN 'idempotencyKey: must not be empty' END) AS errors,
    concat_ws('|',
    CASE WHEN original_op = 'DROP' THEN 'originalOp: not a publish operation' END,
    CASE WHEN entity_type = 'HOTEL' THEN 'entityType: not an entity type' END,
    CASE WHEN coalesce(external_id, '') = '' THEN 'externalId: must not be empty' END,
    CASE WHEN coalesce(idempotency_key, '') = '' THEN 'idempotencyKey: must not be empty' END) AS compensate_errors,
    coalesce(op, '') IN ('UPDATE', 'LINK', 'DEACTIVATE') AND coalesce(external_id, '') = '' AS id_missing
  FROM ({_REQUESTS})""")
def request_errors(spark, sf):
    return _requests(spark, sf).select(
        "event_id", F.array_join(contract.request_errors(), "|").alias("errors"),
        F.array_join(contract.compensate_errors(), "|").alias("compensate_errors"),
        contract.external_id_missing().alias("id_missing"))


# One user stands for one key here: every key is used again and again.
_KEYED = """
  SELECT event_id AS request_ord, concat('k', user_id) AS idempotency_key, 'GUIDE' AS entity_type,
    CASE WHEN user_id % 2 = 0 THEN concat('e', event_id) END AS external_id,
    CASE WHEN user_id % 3 = 0 THEN 'same' ELSE props END AS payload FROM events"""


def _keyed(spark, sf) -> DataFrame:
    inp.table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(_KEYED)


@query("idempotent_apply", f"""
  SELECT r.request_ord, coalesce(f.external_id, concat('ext_guide_', left(sha1(r.idempotency_key), 16))) AS result_external_id,
    r.request_ord > f.request_ord AS idempotent
  FROM ({_KEYED}) r JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY request_ord) AS rn
    FROM ({_KEYED})) WHERE rn = 1) f USING (idempotency_key)""")
def idempotent_apply(spark, sf):
    return contract.apply_once(_keyed(spark, sf)).select("request_ord", "result_external_id", "idempotent")


@query("idempotency_conflicts", f"""SELECT idempotency_key, count(*) AS requests, 'conflict' AS code FROM ({_KEYED})
  GROUP BY idempotency_key HAVING count(DISTINCT payload) > 1""")
def idempotency_conflicts(spark, sf):
    return contract.key_conflicts(_keyed(spark, sf))


_CODE = ("CASE event_id % 8 WHEN 0 THEN 'invalid_request' WHEN 1 THEN 'unauthorized' WHEN 2 THEN 'not_found'"
         " WHEN 3 THEN 'conflict' WHEN 4 THEN 'validation_error' WHEN 5 THEN 'internal' WHEN 6 THEN 'gibberish'"
         " ELSE CAST(NULL AS STRING) END")


@query("error_status", f"""
  SELECT event_id, CASE WHEN s IS NULL THEN 'internal' ELSE c END AS code, coalesce(s, 500) AS status FROM
   (SELECT event_id, c, CASE c WHEN 'invalid_request' THEN 400 WHEN 'unauthorized' THEN 401 WHEN 'not_found' THEN 404
     WHEN 'conflict' THEN 409 WHEN 'validation_error' THEN 422 WHEN 'internal' THEN 500 END AS s
    FROM (SELECT event_id, {_CODE} AS c FROM events))""")
def error_status(spark, sf):
    rows = inp.table(spark, sf, "events").select("event_id", F.expr(_CODE).alias("c"))
    return rows.select("event_id", contract.error_code(F.col("c")).alias("code"),
                       contract.error_status(F.col("c")).alias("status"))


# -- references and existing entities -------------------------------------------------------------

_REF_SQL = f"""
  WITH t AS (
    SELECT 'PRODUCT' AS target_type, batch_id, ord, record_id, key_email, key_code, key_name FROM ({inp.products_sql()})
    UNION ALL SELECT 'TRAVELER', batch_id, ord, record_id, key_email, key_code, key_name FROM ({inp.travelers_sql()})
    UNION ALL SELECT 'GUIDE', batch_id, ord, record_id, key_email, key_code, key_name FROM ({inp.guides_sql()})
    UNION ALL SELECT 'QUALIFICATION', batch_id, ord, record_id, key_email, key_code, key_name FROM ({inp.qualifications_sql()})),
  keys AS (SELECT target_type, key_email AS ref_key, 0 AS rank, batch_id, ord, record_id FROM t WHERE key_email IS NOT NULL
    UNION ALL SELECT target_type, key_code, 1, batch_id, ord, record_id FROM t WHERE key_code IS NOT NULL
    UNION ALL SELECT target_type, key_name, 2, batch_id, ord, record_id FROM t WHERE key_name IS NOT NULL),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_type, ref_key ORDER BY rank, batch_id, ord) AS rn
    FROM keys) WHERE rn = 1),
  refs AS (
    SELECT record_id, 'productRef' AS field, 'PRODUCT' AS target_type, lower(product_ref) AS ref_key FROM ({inp.bookings_sql()})
    UNION ALL SELECT record_id, 'travelerRef', 'TRAVELER', lower(traveler_ref) FROM ({inp.bookings_sql()})
    UNION ALL SELECT record_id, 'guideRef', 'GUIDE', lower(guide_ref) FROM ({inp.qualifications_sql()})
    UNION ALL SELECT record_id, 'productRef', 'PRODUCT', lower(product_ref) FROM ({inp.rules_sql()})
    UNION ALL SELECT record_id, 'qualificationRef', 'QUALIFICATION', lower(qualification_ref) FROM ({inp.rules_sql()}))
  SELECT refs.record_id, field, refs.target_type, refs.ref_key, firsts.record_id AS target_record_id
  FROM refs LEFT JOIN firsts ON firsts.target_type = refs.target_type AND firsts.ref_key = refs.ref_key"""
_REF = ["record_id", "field", "target_type", "ref_key", "target_record_id"]


def _all_entities(spark, sf) -> DataFrame:
    out = None
    for raw in (inp.PRODUCTS, inp.TRAVELERS, inp.GUIDES, inp.BOOKINGS, inp.QUALIFICATIONS, inp.RULES):
        rows = inp.canonical(spark, sf, raw)
        out = rows if out is None else out.unionByName(rows)
    return materialize(out)


@query("resolve_references", _REF_SQL)
def resolve_references(spark, sf):
    return references.resolve_references(_all_entities(spark, sf), scope=()).select(*_REF)


@query("orphan_references", f"SELECT * FROM ({_REF_SQL}) WHERE target_record_id IS NULL")
def orphan_references(spark, sf):
    return references.orphans(references.resolve_references(_all_entities(spark, sf), scope=())).select(*_REF)


_SNAPSHOT = """
  SELECT 'GUIDE' AS entity_type, concat('x', s_suppkey) AS external_id,
    CASE WHEN s_suppkey % 3 = 0 THEN concat('GUIDE', s_suppkey, '@tours.example') END AS email,
    CAST(NULL AS STRING) AS code, CASE WHEN s_suppkey % 4 = 0 THEN concat(upper(s_name), ' MOUNTAIN TOURS ', s_suppkey % 40) END AS name
  FROM supplier"""


@query("match_existing", f"""
  WITH g AS ({inp.guides_sql()}), s AS ({_SNAPSHOT}),
  m AS (SELECT lower(email) AS k, min(external_id) AS x FROM s WHERE email IS NOT NULL GROUP BY 1),
  n AS (SELECT lower(name) AS k, min(external_id) AS x FROM s WHERE name IS NOT NULL GROUP BY 1)
  SELECT record_id, coalesce(m.x, n.x) AS target_external_id,
    CASE WHEN m.x IS NOT NULL THEN 'email_exact' ELSE 'name_exact' END AS strategy,
    'EXISTING_PLATFORM' AS target_kind, 'CANDIDATE' AS status
  FROM g LEFT JOIN m ON m.k = key_email LEFT JOIN n ON n.k = key_name WHERE coalesce(m.x, n.x) IS NOT NULL""")
def match_existing(spark, sf):
    inp.table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    return references.match_existing(_guides(spark, sf), spark.sql(_SNAPSHOT)).select(
        "record_id", "target_external_id", "strategy", "target_kind", "status")
