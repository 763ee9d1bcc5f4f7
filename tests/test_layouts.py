"""Ordered files, bucketed tables, the log written once, alert state in increments."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from kredo.operators import once as ON
from kredo.operators.alert_store import AlertStore
from kredo.operators.alerts import EVENT_COLUMNS, alert_state
from kredo.operators.bucketed import BucketedTables, file_bytes, n_buckets
from kredo.operators.joins import merge_tagged
from kredo.plans import standins as S
from kredo.sources.series import Series
from kredo.sources.versions import Change, Store
from tests.conftest import SF0001, rows


def times(spark, n, start="2024-01-01 00:00:00", seed=1):
    """Rows in no order, several with the same time."""
    rng = random.Random(seed)
    base = dt.datetime.fromisoformat(start)
    data = [(i, base + dt.timedelta(minutes=rng.randint(0, n // 3))) for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "log_id long, timestamp timestamp_ntz")


def want(*frames):
    all_rows = sorted((r["timestamp"], r["log_id"]) for f in frames for r in f.collect())
    return [(place, i, t) for place, (t, i) in enumerate(all_rows)]


def got(df):
    return sorted((r["place"], r["log_id"], r["timestamp"]) for r in df.collect())


def test_pages_and_stretches(spark, tmp_path):
    series = Series(spark, str(tmp_path / "s"))
    a, b = times(spark, 500), times(spark, 300, "2024-02-01 00:00:00", 2).withColumn("log_id", F.col("log_id") + 1000)
    series.write(a, rows_per_file=50)
    series.append(b, rows_per_file=50)
    placed = want(a, b)
    for offset, limit in ((0, 10), (395, 25), (495, 10), (790, 50), (800, 5), (0, 10_000)):
        page = series.page(offset, limit)
        assert [(r["place"], r["log_id"], r["timestamp"]) for r in page.collect()] == placed[offset:offset + limit]
        newest = [(r["place"], r["log_id"], r["timestamp"]) for r in series.page(offset, limit, newest_first=True).collect()]
        assert newest == placed[::-1][offset:offset + limit]
    low, high = placed[100][2], placed[620][2]
    assert got(series.between(F.lit(low), F.lit(high))) == [p for p in placed if low < p[2] <= high]
    assert series.between(F.lit(dt.datetime(2030, 1, 1)), F.lit(dt.datetime(2031, 1, 1))).count() == 0


def test_a_deep_page_reads_its_file_alone(spark, tmp_path):
    series = Series(spark, str(tmp_path / "s"))
    series.write(times(spark, 2000), rows_per_file=200)
    bounds = sorted((r["place"], r["rows"]) for r in series.files().collect())
    assert len(bounds) >= 8 and sum(n for _, n in bounds) == 2000
    place, n = bounds[5]
    page = series.page(place + 3, min(20, n - 3))
    assert len(page.inputFiles()) == 1
    assert "Exchange rangepartitioning" not in series.between(F.lit(dt.datetime(2024, 1, 1)), F.lit(dt.datetime(2024, 1, 2)))._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_place_are_refused(spark, tmp_path):
    series = Series(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="without timestamp"):
        series.write(spark.createDataFrame([(1, None)], "log_id long, timestamp timestamp_ntz"))
    series.write(times(spark, 30))
    with pytest.raises(ValueError, match="lie before"):
        series.append(times(spark, 5))


def test_bucketed_merge_moves_no_rows(spark, tmp_path):
    sides = {"bureau": S.bureau(spark, SF0001), "previous": S.previous_applications(spark, SF0001), "pos_cash": S.pos_cash(spark, SF0001),
             "credit_card": S.credit_card(spark, SF0001), "installments": S.installments(spark, SF0001)}
    train, test = S.train_and_test(spark, SF0001)
    tables = BucketedTables(spark, str(tmp_path / "t"), buckets=4)
    tables.write_main(train, test)
    for kind, df in sides.items():
        tables.write(kind, df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = tables.merge_all()
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 5
        plain = merge_tagged({"application_train": train, "application_test": test, **sides})
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        one, two = rows(merged, "SK_ID_CURR"), rows(plain.select(*merged.columns), "SK_ID_CURR")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(one) == len(two)
    for a, b in zip(one, two):
        assert all(a[k] == (pytest.approx(b[k]) if isinstance(b[k], float) else b[k]) for k in b)
    tables.drop()
    assert not spark.catalog.tableExists(tables.name("bureau"))
    assert n_buckets(1 << 40) == 8192 and n_buckets(5) == 1


def test_buckets_grow_with_the_source_files(spark, monkeypatch):
    from kredo.plans import tables as plans

    li = S.bureau(spark, SF0001)
    size = os.path.getsize(f"{SF0001}/lineitem.parquet")
    assert file_bytes(li) == size and file_bytes(li, li) == 2 * size
    few = plans.q_merge_all_bucketed(spark, SF0001)
    assert "out of 8" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(plans, "SOURCE_BYTES", size // 4)
    many = plans.q_merge_all_bucketed(spark, SF0001)
    found = {int(n) for n in re.findall(r"SelectedBucketsCount: \d+ out of (\d+)", many._jdf.queryExecution().executedPlan().toString())}
    assert len(found) == 1 and 12 <= min(found) <= 40      # lineitem is read three times
    assert rows(few, "SK_ID_CURR", "split") == rows(many, "SK_ID_CURR", "split")


def requests(spark, rows_):
    return spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), p) for k, h, p in rows_],
                                 "request_id long, delivered_at timestamp_ntz, payload string")


def logged(store):
    return sorted(((r["request_id"], r["payload"]) for r in store.read("requests").collect()), key=str)


def test_requests_are_logged_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ON, "COMPACT_AFTER", 1)
    store = Store(spark, str(tmp_path / "s"))
    first = requests(spark, [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (None, 0, "x"), (None, 0, "x")])
    assert ON.log_once(store, first, 0) == {"received": 5, "new": 4}
    assert ON.log_once(store, first, 0) == {"received": 0, "new": 0}             # a replayed batch
    assert ON.log_once(store, requests(spark, [(2, 500, "late"), (3, 2, "d"), (1, 9000, "late")]), 1)["new"] == 1
    publish = Change.publish
    monkeypatch.setattr(Change, "publish", lambda self: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        ON.log_once(store, requests(spark, [(4, 0, "e")]), 2)
    monkeypatch.setattr(Change, "publish", publish)
    assert ON.log_once(store, requests(spark, [(4, 0, "e"), (3, 700, "late")]), 2)["new"] == 1
    assert logged(store) == sorted([(1, "a"), (2, "c"), (3, "d"), (4, "e"), (None, "x"), (None, "x")], key=str)


def test_a_full_filter_loses_no_request(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ON, "BITS", 7)
    monkeypatch.setattr(ON, "BUCKETS", 2)
    store = Store(spark, str(tmp_path / "s"))
    for i in range(3):
        batch = requests(spark, [(k, 24 * i, str(k)) for k in range(300 * i, 300 * i + 400)])
        assert ON.log_once(store, batch, i)["new"] == (400 if i == 0 else 300)
    assert [k for k, _ in logged(store)] == sorted(range(1000), key=lambda k: str((k, str(k))))


def events(spark, seed, n):
    rng = random.Random(seed)
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=seed * 1000 + i) for i in range(n)]
    return spark.createDataFrame([(rng.randint(0, 30), "latency", "INFO", "m", "{}", rng.random() < .4, dt.datetime(2024, 1, 1), t)
                                  for t in at], "alert_id long, alert_type string, severity string, message string, metadata string, "
                                                "acknowledged boolean, created_at timestamp_ntz, updated_at timestamp_ntz")


def test_alert_state_in_increments(spark, tmp_path):
    alerts = AlertStore(Store(spark, str(tmp_path / "s")), buckets=8)
    seen = None
    for i in range(4):
        batch = events(spark, i, 25 if i < 3 else 1)
        seen = batch if seen is None else seen.unionByName(batch)
        alerts.add(batch)
        if i in (1, 3):
            before = alerts.store.manifest()["tables"].get("snapshot", {"parts": {}})["parts"]
            written = alerts.compact()
            after = alerts.store.manifest()["tables"]["snapshot"]["parts"]
            assert {b for b in after if after[b] != before.get(b)} == set(written)
        assert rows(alerts.current(), "alert_id") == rows(alert_state(seen).select(*EVENT_COLUMNS), "alert_id")
    assert alerts.compact() == [] and alerts.add(events(spark, 9, 1).limit(0)) == 0
    assert os.path.isdir(str(tmp_path / "s"))
