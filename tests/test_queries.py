"""Every registered query against its reference SQL, and the plans it runs with."""

import pytest

import __spark_entry__ as registry
from check_queries import compare, open_tables

QUERIES = registry._queries
STATEMENTS = registry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return open_tables("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, folder, connection, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "NestedLoop", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan, plan
    if name in STATEMENTS:
        assert compare(df, connection, STATEMENTS[name]) == "same"
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert len(rows) > 0 and rows[0]["risk_level"] == "CRITICAL"


def test_filters_and_columns_reach_the_scan(spark, folder):
    def plan(name):
        return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()

    trailing = plan("trailing_weather")
    assert "GreaterThanOrEqual(l_shipdate" in trailing and "LessThan(l_shipdate" in trailing
    fresh = plan("latest_valid_forecast")
    assert "GreaterThan(o_orderdate" in fresh
    by_crop = plan("yield_by_crop")
    assert "l_tax" not in by_crop and "p_name" not in by_crop


def test_large_joins_use_the_size_of_stored_tables(spark, folder):
    plan = QUERIES["year_weather_join"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1")
    try:
        plan = QUERIES["year_weather_join"](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set(limit, before)
