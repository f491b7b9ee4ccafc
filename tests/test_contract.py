import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_entry_counts_all_parts(spark):
    out = entry.entry(spark)
    assert out.columns == ["batch_id", "entity_type", "records", "invalid", "duplicates"]
    assert out.groupBy().sum("records").first()[0] == spark.read.parquet(f"{SMALL}/part.parquet").count()


@pytest.mark.parametrize("name", [
    "normalize_bookings", "plan_of_orders", "resolve_sheets", "exact_travelers", "commit_ledger",
    "resolve_references", "idempotent_apply", "purged_sessions", "similar_addresses",
])
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["sample_rows"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(turn,5)" in plan
    plan = entry.queries()["idempotency_conflicts"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,props:string>" in plan
