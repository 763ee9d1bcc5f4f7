"""Hourly states, percentiles from sketches, late rows and replayed batches."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from kredo.operators import hourly as H
from kredo.sources.versions import Change, Store
from kredo.streaming import late as LT
from tests.conftest import rows as sorted_rows

SCHEMA = "log_id long, t string, latency_seconds double, score double, error_message string"


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("log_id", F.col("t").cast("timestamp_ntz").alias("timestamp"),
                                                      "latency_seconds", "score", "error_message")


def sample(n, seed=1):
    rng = random.Random(seed)
    return [(i, f"2024-01-0{rng.randint(1, 3)} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00",
             rng.choice([None, rng.random()]), rng.random(), rng.choice([None, None, "failed"])) for i in range(n)]


def hours_of(spark, rows):
    return sorted_rows(H.metrics(H.hour_states(log(spark, rows)), ["time_bucket"]), "time_bucket")


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for k in y:
            assert x[k] == pytest.approx(y[k]) if isinstance(y[k], float) else x[k] == y[k], (k, x, y)


def test_late_rows_are_kept_and_their_hours_restated(spark, tmp_path):
    rows = sample(200)
    store = Store(spark, str(tmp_path / "s"))
    rng = random.Random(3)
    rng.shuffle(rows)
    batches = [rows[:80], rows[80:150], [], rows[150:]]
    seen, late = None, 0
    for i, batch in enumerate(batches):
        if seen:
            late += sum(t[:13] < seen[:13] and t[:14] + "00:00" <= seen and (t[:13] + ":59:59") < seen for _, t, *_ in batch)
        notes = LT.restate(store, log(spark, batch), i)
        newest = max([t for _, t, *_ in rows[:0] + [r for b in batches[:i + 1] for r in b]], default=None)
        seen = notes.get("watermark")
    done = sorted_rows(store.read("hours").drop("log_date", "n_late", "n_batches"), "time_bucket")
    close(done, hours_of(spark, rows))
    assert store.read("late").count() == late > 0
    assert store.read("hours").agg(F.sum("n_late")).first()[0] == late
    assert newest and notes["dropped"] == 0 and notes["batch"] == 3


def test_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    one, two = sample(30, 4), sample(30, 5)
    LT.restate(store, log(spark, one), 0)
    publish = Change.publish
    monkeypatch.setattr(Change, "publish", lambda self: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        LT.restate(store, log(spark, two), 1)
    monkeypatch.setattr(Change, "publish", publish)
    close(sorted_rows(store.read("hours").select(*hours_of(spark, one)[0]), "time_bucket"), hours_of(spark, one))
    LT.restate(store, log(spark, two), 1)
    LT.restate(store, log(spark, two), 1)
    LT.restate(store, log(spark, one), 0)
    assert store.versions() == [1, 2]
    close(sorted_rows(store.read("hours").select(*hours_of(spark, one)[0]), "time_bucket"), hours_of(spark, one + two))


def test_only_days_with_new_rows_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    LT.restate(store, log(spark, sample(60)), 0)
    before = store.manifest()["tables"]["hours"]["parts"]
    LT.restate(store, log(spark, [(99, "2024-01-02 05:00:00", 1., 1., None), (100, None, 1., 1., None)]), 1)
    after = store.manifest()["tables"]["hours"]["parts"]
    assert {d for d in after if after[d] != before[d]} == {"2024-01-02"}
    assert store.manifest()["notes"]["dropped"] == 1


def test_merged_states_are_those_of_all_rows(spark):
    rows = sample(150, 7)
    parts = H.hour_states(log(spark, rows[:70])).unionByName(H.hour_states(log(spark, rows[70:])))
    close(sorted_rows(H.metrics(H.merged(parts, ["time_bucket"]), ["time_bucket"]), "time_bucket"), hours_of(spark, rows))


def test_span_without_a_latency(spark):
    only = log(spark, [(1, "2024-01-01 00:30:00", None, .5, "failed")])
    r = H.metrics(H.hour_states(only), ["time_bucket"]).first()
    assert r["p95_latency_seconds"] is None and r["error_rate"] == 100.0


def test_rank_error_of_large_sketches(spark):
    n = 300_000
    value = F.hash("id").cast("double")
    logs = spark.range(n).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id") % 24)).alias("timestamp"),
        value.alias("latency_seconds"), F.lit(.5).alias("score"), F.lit(None).cast("string").alias("error_message"))
    day = H.span_stats(H.hour_states(logs), *[F.lit(t).cast("timestamp_ntz") for t in ("2024-01-01", "2024-01-02")]).first()
    for p, name in ((0.95, "p95_latency_seconds"), (0.99, "p99_latency_seconds")):
        rank = logs.where(F.col("latency_seconds") <= day[name]).count() / n
        assert abs(rank - p) < 0.001
    assert day["total_requests"] == n


def test_watermark_delay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    LT.restate(store, log(spark, [(1, "2024-01-01 10:05:00", 1., 1., None)]), 0, timedelta(minutes=10))
    LT.restate(store, log(spark, [(2, "2024-01-01 09:30:00", 1., 1., None), (3, "2024-01-01 08:59:00", 1., 1., None)]), 1)
    assert [r["log_id"] for r in store.read("late").collect()] == [3]
