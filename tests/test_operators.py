import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom import model
from gridloom.operators import batches, contract, ledger, paging, publish, resolve, review, suggest


def test_entity_resolution_precedence(spark):
    sheets = spark.createDataFrame([
        ("one", "in/products.csv", 0, None, 3), ("two", "in/x.csv", 0, None, 1), ("three", "w.xlsx", 0, "GUIDES", 2),
        ("three", "w.xlsx", 1, "Sheet9", 2), ("three", "w.xlsx", 2, None, 0), ("four", "a/staffing-rules.csv", 0, None, 1),
        ("five", "in/products.csv", 0, None, 1),
    ], "batch_id string, source_file string, sheet_index int, sheet_name string, row_count bigint")
    mappings = spark.createDataFrame([
        ("two", 0, "TRAVELER", None, {"email": "Contact"}), ("three", 0, "PRODUCT", "guides", {"name": "A"}),
        ("three", 1, "BOOKING", "Guides", {}), ("three", 2, "GUIDE", None, {}),
        ("five", 0, "GUIDE", "Products", {"email": "M"}),
    ], model.MAPPING_SCHEMA)
    resolved = resolve.resolve_sheets(sheets, mappings)
    got = {(r.batch_id, r.sheet_index): (r.entity_type, r.columns) for r in resolved.collect()}
    assert got == {
        ("one", 0): ("PRODUCT", {}), ("two", 0): ("TRAVELER", {"email": "Contact"}),
        ("three", 0): ("PRODUCT", {"name": "A"}), ("three", 1): (None, {}), ("three", 2): (None, {}),
        ("four", 0): (None, {}), ("five", 0): ("GUIDE", {"email": "M"}),
    }
    assert {(r.batch_id, r.sheet) for r in resolve.unmapped_sheets(resolved).collect()} == {
        ("three", "Sheet9"), ("three", "sheet#2"), ("four", "sheet#0")}


def test_suggestions(spark):
    sheets = spark.createDataFrame([
        ("t", ["Email", "Full Name", "Mobile"], "TRAVELER"), ("Products", ["SKU", "product"], None),
        ("what", ["Email"], None), ("x", ["nothing"], "GUIDE"),
    ], "sheet_name string, headers array<string>, entity_hint string")
    got = {r.sheet_name: r for r in suggest.suggest_mapping(sheets).collect()}
    assert [(m.field, m.header, m.confidence) for m in got["t"].mapping] == [
        ("fullName", "Full Name", 0.8), ("email", "Email", 0.95), ("phone", "Mobile", 0.8)]
    assert not got["t"].needs_review and got["Products"].needs_review
    assert [(m.field, m.header) for m in got["Products"].mapping] == [("name", "product"), ("sku", "SKU")]
    assert (got["what"].entity_type, got["what"].mapping, got["what"].needs_review) == ("PRODUCT", [], True)
    assert got["x"].needs_review


def test_pages(spark):
    at = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("id3", at), ("id1", at), ("id2", at)], "id string, created_at timestamp_ntz")
    first = paging.page(rows, limit=2).orderBy(F.col("id").desc()).collect()
    assert [(r.id, r.next_cursor) for r in first] == [("id3", "id2"), ("id2", "id2")]
    assert [(r.id, r.next_cursor) for r in paging.page(rows, 2, "id2").collect()] == [("id1", None)]
    assert paging.page(rows, 2, "gone").isEmpty()
    for bad in (0, 201):
        with pytest.raises(ValueError):
            paging.page(rows, bad)


def test_sequence_numbers_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(publish, "CHUNK_BITS", 2)
    rows = spark.range(50).select(F.concat(F.lit("b"), F.col("id") % 2).alias("batch_id"), (F.col("id") * 3).alias("row_ord"))
    got = publish.number_rows(rows).orderBy("batch_id", "row_ord").collect()
    for batch in ("b0", "b1"):
        assert [r.sequence for r in got if r.batch_id == batch] == list(range(25))


def test_gate_reasons(spark):
    rows = spark.createDataFrame([("a", "READY"), ("b", "READY"), ("c", "IN_REVIEW")], "batch_id string, status string")
    items = spark.createDataFrame([("b", "OPEN", "DUPLICATE")], "batch_id string, status string, reason string")
    got = {r.batch_id: r.reject_reason for r in publish.gate(rows, "preview", items).collect()}
    assert got == {"a": None, "b": "batch b has 1 unresolved review item(s)", "c": "batch c cannot preview from status IN_REVIEW"}


def test_readiness_map(spark):
    rows = spark.createDataFrame([("a", "READY"), ("b", "IN_REVIEW")], "batch_id string, status string")
    items = spark.createDataFrame([("b", "OPEN", "DUPLICATE"), ("b", "RESOLVED", "LOW_CONFIDENCE")], "batch_id string, status string, reason string")
    ready = review.readiness(rows, items)
    got = {r.batch_id: (r.ready, r.m) for r in ready.withColumn("m", review.open_by_reason(ready)).collect()}
    assert got == {"a": (True, {}), "b": (False, {"DUPLICATE": 1})}


def test_counts_merge_shallow_with_timings_merged(spark):
    df = spark.sql("""SELECT named_struct('total', 1L, 'flags', 2L, 'timings', map('a', 1L, 'b', 2L)) AS old,
      named_struct('total', 5L, 'flags', CAST(NULL AS BIGINT), 'timings', map('b', 9L)) AS new""")
    got = df.select(batches.merge_counts(F.col("old"), F.col("new"), ("total", "flags", "timings")).alias("m")).first().m
    assert got.asDict() == {"total": 5, "flags": 2, "timings": {"a": 1, "b": 9}}


ACTION = ("batch_id string, action_id string, record_id string, entity_type string, op string, status string, sequence bigint,"
          " payload string, target_external_id string, result_external_id string, error string, compensation_of string,"
          " idempotency_key string")


def actions(spark, n=4):
    return spark.createDataFrame([
        ("b", f"r{i}:CREATE", f"r{i}", "PRODUCT", "CREATE", "PLANNED", i, "{}", None, None, None, None, f"b:r{i}:CREATE")
        for i in range(n)], ACTION)


def outcomes(spark, *rows):
    return spark.createDataFrame(rows, model.OUTCOME_SCHEMA)


def test_commit_stops_at_the_first_failure_and_resumes(spark):
    rows = spark.createDataFrame([("b", "PREVIEWED")], "batch_id string, status string")
    first = ledger.reconcile(actions(spark), outcomes(
        spark, ("r0:CREATE", True, "x0", None), ("r1:CREATE", False, None, "simulated"), ("r2:CREATE", True, "x2", None)))
    got = [(r.status, r.result_external_id, r.error) for r in first.orderBy("sequence").collect()]
    assert got == [("COMMITTED", "x0", None), ("FAILED", None, "simulated"), ("PLANNED", None, None), ("PLANNED", None, None)]
    state = ledger.batch_outcome(rows, first).first()
    assert (state.status, state.error_stage, state.error_action_id) == ("FAILED", "commit", "r1:CREATE")
    assert [r.action_id for r in publish.work_set(first).collect()] == ["r1:CREATE", "r2:CREATE", "r3:CREATE"]
    again = ledger.reconcile(first, outcomes(
        spark, ("r0:CREATE", True, "other", None), ("r1:CREATE", True, "x1", None), ("r2:CREATE", True, None, None), ("r3:CREATE", True, "x3", None)))
    got = again.orderBy("sequence").collect()
    assert {r.status for r in got} == {"COMMITTED"} and got[0].result_external_id == "x0" and got[1].error is None
    assert got[2].result_external_id.startswith("ext_product_") and len(got[2].result_external_id) == 28
    assert ledger.batch_outcome(rows, again).first().status == "COMMITTED"
    assert publish.work_set(again).isEmpty()


def test_preview_rebuilds_planned_rows_only(spark):
    old = actions(spark, 2).withColumn("status", F.when(F.col("sequence") == 0, "COMMITTED").otherwise("PLANNED"))
    new = actions(spark, 3)
    got = sorted((r.action_id, r.status) for r in publish.replan(old, new).collect())
    assert got == [("r0:CREATE", "COMMITTED"), ("r0:CREATE", "PLANNED"), ("r1:CREATE", "PLANNED"), ("r2:CREATE", "PLANNED")]
    summary = publish.plan_summary(old).first()
    assert (summary.total, summary.op_create, summary.status_planned, summary.status_committed) == (2, 2, 1, 1)


def test_validation_decision_suppresses_the_row(spark):
    """Accepting a validation item confirms the same record's duplicate candidate."""
    canonical = spark.sql(f"SELECT 'b' AS batch_id, 'b:0:1' AS record_id, 1L AS row_ord, 'GUIDE' AS entity_type, 'DRAFT' AS status,"
                          f" from_json('{{\"fullName\": \"Ann\"}}', '{model.canonical_type()}') AS data, CAST(NULL AS STRING) AS external_id,"
                          " CAST(NULL AS STRING) AS dedupe_key, CAST(NULL AS STRING) AS key_email, CAST(NULL AS STRING) AS key_code,"
                          " 'ann' AS key_name, CAST(NULL AS TIMESTAMP_NTZ) AS key_date, CAST(array() AS ARRAY<STRING>) AS validation_errors")
    candidates = spark.createDataFrame([("b", "c", "b:0:1", "GUIDE", "INTRA_BATCH", None, "b:0:0", "CANDIDATE")],
        "batch_id string, candidate_id string, record_id string, entity_type string, target_kind string, target_external_id string,"
        " target_record_id string, status string")
    items = spark.createDataFrame([("b", "b:0:1:VALIDATION_ERROR", "b:0:1", "GUIDE", "VALIDATION_ERROR", "OPEN")],
        "batch_id string, review_item_id string, record_id string, entity_type string, reason string, status string")
    at = dt.datetime(2026, 1, 1)
    decisions = spark.createDataFrame([
        ("d1", "b:0:1:VALIDATION_ERROR", "REMAP", "me", at, None, None, "plat-1"),
        ("d2", "b:0:1:VALIDATION_ERROR", "REJECT", "me", at, None, None, None),
        ("d3", "nowhere", "ACCEPT", "me", at, None, None, None)], "decision_id string, " + model.DECISION_SCHEMA)
    out = review.decide(canonical, candidates, items, decisions)
    after = out.candidates.first()
    assert (after.status, after.target_kind, after.target_external_id) == ("CONFIRMED", "INTRA_BATCH", "plat-1")
    assert publish.plan(out.canonical, out.candidates).isEmpty()
    assert {(r.decision_id, r.reject_reason) for r in out.rejects.collect()} == {("d2", "not_open"), ("d3", "not_found")}
    applied = review.rule_on(items, decisions).filter("reject_reason is null")
    assert review.suppression_warning(out.candidates, items, applied).count() == 1


def test_contract_rules(spark):
    df = spark.createDataFrame([("CREATE", "GUIDE", None, "k"), ("LINK", "GUIDE", "", "k"), (None, "X", "e", "")],
                               "op string, entity_type string, external_id string, idempotency_key string")
    got = [tuple(r) for r in df.select(contract.request_errors(), contract.external_id_missing()).collect()]
    assert got == [([], False), (["externalId: must not be empty"], True),
                   (["op: not a publish operation", "entityType: not an entity type", "idempotencyKey: must not be empty"], False)]
    codes = spark.createDataFrame([("conflict",), ("odd",), (None,)], "c string")
    assert [tuple(r) for r in codes.select(contract.error_code(F.col("c")), contract.error_status(F.col("c"))).collect()] == [
        ("conflict", 409), ("internal", 500), ("internal", 500)]
