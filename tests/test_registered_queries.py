"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, database
from checks.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["artist", "period", "royalties", "quantity"]
    assert frame.count() == 100


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    good, text = compare(spark, connection, FOLDER, name, queries()[name], oracle_sql()[name])
    assert good, text


BIG = [
    "royalties_by_artist_period", "royalties_by_label", "royalty_fact", "contracts_latest_with_calendar", "booking_quality",
    "missed_opportunities", "match_coverage", "names_matched_by_keyword", "status_changes", "routing_mix", "category_drift",
]


@pytest.mark.parametrize("name", BIG)
def test_plan_has_no_pairing_of_all_rows_and_no_python(spark, name):
    """Also with every table too big to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInPandas|FlatMapGroups", plan)


def test_queries_are_right_without_broadcasts(spark, connection):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("royalties_by_label", "booking_quality", "missed_opportunities", "match_coverage"):
            good, text = compare(spark, connection, FOLDER, name, queries()[name], oracle_sql()[name])
            assert good, f"{name}: {text}"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_month_range_reaches_the_scan(spark):
    plan = queries()["range_end_only"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_shipdate,1996-01-01" in plan


def test_month_range_reaches_the_scans_of_the_default_source(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = queries()["royalties_by_artist_period"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    for day in ("l_shipdate", "o_orderdate"):
        assert f"GreaterThanOrEqual({day},1997-03-01" in plan and f"LessThan({day},1998-11-01" in plan


def test_constant_tables_are_not_shuffled_for(spark):
    plan = queries()["ledger_revenue_cost"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(grupo" not in plan


def test_the_register_is_read_a_few_times(spark):
    plan = queries()["artist_matches"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("customer.parquet") <= 5
