import datetime as dt

import pytest

from kredo.functions import bands as B
from kredo.operators import logstats as L
from pyspark.sql import functions as F

SCHEMA = ("log_id long, timestamp timestamp_ntz, prediction_type string, score double, "
          "latency_seconds double, cpu_usage_pct double, gpu_usage_pct double, gpu_memory_mb double, "
          "error_message string")
AS_OF = "2026-03-29 12:00:00"


def test_frame_stats_fixture(spark):
    ts = dt.datetime(2026, 3, 29, 9, 0, 0)
    df = spark.createDataFrame([(1, ts, "single", 0.42, 0.15, 17.5, 0.0, 0.0, None)], SCHEMA)
    r = L.frame_stats(df, AS_OF).first()
    assert (r.total, r.today_count, r.avg_score, r.avg_cpu_usage_pct, r.avg_gpu_usage_pct) == (1, 1, 0.42, 17.5, 0.0)


def test_utc_aware_to_local_day(spark):
    from kredo.functions.timeutil import to_local_naive
    # 23:30 UTC on 28 March is 00:30 local (CET, +1) on the 29th; next day DST (+2)
    df = spark.createDataFrame([(dt.datetime(2026, 3, 28, 23, 30),), (dt.datetime(2026, 3, 29, 1, 30),)],
                               "ts timestamp_ntz")
    out = [r.l for r in df.select(to_local_naive(F.col("ts")).alias("l")).orderBy("l").collect()]
    assert out == [dt.datetime(2026, 3, 29, 0, 30), dt.datetime(2026, 3, 29, 3, 30)]


def test_stats_by_type_empty_type_and_bands(spark):
    ts = dt.datetime(2026, 3, 29, 11, 30)
    rows = [(1, ts, "single", 0.7, 0.2, 1.0, None, None, None),
            (2, ts, "single", 0.5, 0.4, 1.0, None, None, None),
            (3, ts - dt.timedelta(hours=3), "single", None, 0.1, 1.0, None, None, "boom")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.label: r for r in L.stats_by_type(df, AS_OF).collect()}
    assert out["batch"].total == 0 and out["batch"].avg_score is None and out["batch"].high_risk == 0
    s = out["single"]
    assert (s.total, s.high_risk, s.medium_risk, s.low_risk, s.last_hour) == (3, 1, 1, 0, 2)
    assert s.avg_latency_ms == pytest.approx(700 / 3)
    assert out["combined"].total == 3


def test_views(spark):
    now = dt.datetime(2026, 3, 29, 12, 0)
    rows = [(i, now - dt.timedelta(hours=i), "batch", i / 30, i / 10, 1.0, None, None,
             "x" if i % 5 == 0 else None) for i in range(1, 30)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("client_id", F.col("log_id") * 7)
    r = L.last_24h_stats(df, AS_OF).first()
    assert r.total_predictions == 23 and r.failed_predictions == 4
    assert r.error_rate_pct == round(100 * 4 / 23, 2)
    an = L.latency_anomalies(df, AS_OF).collect()
    lat = sorted(i / 10 for i in range(1, 24))
    p95 = lat[20] + 0.9 * (lat[21] - lat[20])      # position 0.95 * (23 - 1) = 20.9
    assert sorted(x.log_id for x in an) == [i for i in range(1, 24) if i / 10 > p95] == [22, 23]
    assert an[0].p95_latency == pytest.approx(p95)
    dist = {x.risk_bucket: x["count"] for x in L.score_distribution(df, AS_OF, days=7).collect()}
    assert sum(dist.values()) == 29


def test_bands():
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(0.2,), (0.45,), (0.6,), (None,)], "s double")
    out = df.select(B.risk_bucket("s").alias("a"), B.type_risk("s").alias("b"),
                    B.history_risk("s").alias("c"), B.decision("s", 0.5).alias("d")).collect()
    assert [tuple(r) for r in out] == [
        ("0.2-0.4 (Low Risk)", "low", "low", "accept"),
        ("0.4-0.6 (Medium Risk)", "low", "medium", "accept"),
        ("0.6-0.8 (High Risk)", "medium", "high", "refuse"),
        ("0.8-1.0 (Very High Risk)", None, None, None)]


def test_page_clamp(spark):
    from kredo.operators.history import page, page_count
    df = spark.range(23).withColumnRenamed("id", "log_id")
    assert page_count(df, 10) == 3
    last = [r.log_id for r in page(df, [F.col("log_id").desc()], 9, 10, clamp=True).collect()]
    assert last == [2, 1, 0]
