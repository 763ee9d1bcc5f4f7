"""Plan guards: properties every registered query must keep at any scale."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF0001

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_no_cross_join_or_row_udf(spark, key):
    plan = _plan(E.queries()[key](spark, SF0001))
    for word in FORBIDDEN:
        assert word not in plan, f"{key}: {word}"


def test_pushdown_and_pruning(spark):
    q = E.queries()
    text = _plan(q["client_features"](spark, SF0001))
    # only the used lineitem columns are read; the time window reaches the scan
    scan = [line for line in text.split("\n") if "lineitem.parquet" in line][0]
    cols = re.search(r"FileScan parquet \[([^\]]*)\]", scan).group(1)
    assert [c.split("#")[0] for c in cols.split(",")] == [
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate"]
    last24 = _plan(q["last_24h_stats"](spark, SF0001))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in last24 and "LessThanOrEqual(ts," in last24


def test_plan_does_not_grow_with_shuffle_partitions(spark):
    import time

    from kredo.plans.registry import QUERIES
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "410000")
        began = time.perf_counter()
        QUERIES["hourly_performance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        assert time.perf_counter() - began < 15
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
