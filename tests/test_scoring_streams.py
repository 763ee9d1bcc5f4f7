import datetime as dt
import json
import os
import tempfile

import pytest

from kredo.operators import scoring as SC
from kredo.streaming import monitor as M

NUMERIC = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "DAYS_BIRTH"]
CATEGORICAL = ["CODE_GENDER"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(float(50000 + 1000 * i), float(100000 + 7000 * (i % 9)), float(-10000 - 97 * i),
             "F" if i % 3 else "M", float(i % 2)) for i in range(60)]
    train = spark.createDataFrame(rows, "AMT_INCOME_TOTAL double, AMT_CREDIT double, DAYS_BIRTH double, "
                                        "CODE_GENDER string, label double")
    return SC.fit(train, NUMERIC, CATEGORICAL)


def test_request_scoring_rejects_and_isolates(spark, model):
    ok = {"SK_ID_CURR": 100002, "AMT_INCOME_TOTAL": 202500.0, "AMT_CREDIT": 406597.5,
          "DAYS_BIRTH": -9461, "CODE_GENDER": "M"}
    bad = dict(ok, SK_ID_CURR=100003, AMT_INCOME_TOTAL="hh")
    reqs = spark.createDataFrame([(1, json.dumps(ok)), (2, json.dumps([ok, bad])), (3, json.dumps("x")),
                                  (4, "[1, 2]"), (5, json.dumps([ok]))], "req long, data string")
    out = SC.score_requests(reqs, model, NUMERIC, CATEGORICAL, id_cols=["req"]).collect()
    by = {(r.req, r.item_no): r for r in out}
    assert 0.0 <= by[(1, 0)].score <= 1.0 and by[(1, 0)].prediction_type == "single"
    assert by[(2, 0)].score is not None and by[(2, 0)].prediction_type == "batch"
    assert by[(2, 1)].score is None and "AMT_INCOME_TOTAL" in by[(2, 1)].error_message
    assert by[(2, 1)].client_id == 100003
    assert by[(3, 0)].score is None and "not a JSON object" in by[(3, 0)].error_message
    assert by[(4, 0)].score is None and by[(4, 0)].error_message  # whole payload rejected
    assert by[(5, 0)].prediction_type == "batch"                    # a batch of one


def test_importance_and_contributions(spark, model):
    names = SC.feature_names(model, NUMERIC, CATEGORICAL)
    imp = SC.feature_importance(spark, model, names, top_n=3).collect()
    assert len(imp) == 3 and imp[0].importance >= imp[-1].importance
    df = spark.createDataFrame([(1, 60000.0, 120000.0, -11000.0)], "id long, AMT_INCOME_TOTAL double, "
                                                                     "AMT_CREDIT double, DAYS_BIRTH double")
    c = SC.linear_contributions(df, model, NUMERIC, CATEGORICAL, "id", top_k=2).collect()
    assert [r["rank"] for r in c] == [1, 2]
    every = SC.linear_contributions(df, model, NUMERIC, CATEGORICAL, "id", top_k=None).collect()
    assert {r.feature for r in every} == set(names)


def test_watermark_drops_late_rows_and_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="kredo-stream-")
    src = os.path.join(base, "src")
    schema = "log_id long, timestamp timestamp_ntz, latency_seconds double, score double, error_message string"
    t0 = dt.datetime(2026, 1, 1, 10, 0)
    on_time = [(i, t0 + dt.timedelta(minutes=7 * i), 0.1 * i, 0.5, None) for i in range(30)]
    more = [(50, dt.datetime(2026, 1, 1, 13, 40), 0.2, 0.5, None)]
    late = [(100, dt.datetime(2026, 1, 1, 8, 0), 9.0, 0.9, "x")]
    # late rows are filtered with the watermark of the previous micro-batch,
    # so the late file is the third batch
    for i, part in enumerate((on_time, more, late)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(src, f"part={i}"))
    on_time = on_time + more
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = os.path.join(base, "out")
    info = M.run_window_stream(stream, out, os.path.join(base, "ckpt"))
    assert info["rows_dropped_by_watermark"] == 1
    got = {r.time_bucket: r.total_requests for r in M.latest_windows(spark, out).collect()}
    batch = {}
    for _, ts, *_ in on_time:
        h = ts.replace(minute=0)
        batch[h] = batch.get(h, 0) + 1
    assert got == batch


def test_replayed_micro_batch_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="kredo-stream-")
    out = os.path.join(base, "out")
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 10), 3)], "time_bucket timestamp_ntz, n long")
    M._write_batch(df, out, 0)
    M._write_batch(df, out, 0)          # the same batch replayed after a failure
    M._write_batch(df.withColumn("n", df.n + 1), out, 1)
    got = spark.read.parquet(out)
    assert got.count() == 2
    assert [r.n for r in M.latest_windows(spark, out).collect()] == [4]


def test_windows_do_not_depend_on_session_zone(spark):
    rows = [(1, dt.datetime(2026, 1, 1, 10, 5), 0.1, 0.5, None), (2, dt.datetime(2026, 1, 1, 10, 50), 0.2, 0.5, None)]
    df = spark.createDataFrame(rows, "log_id long, timestamp timestamp_ntz, latency_seconds double, "
                                     "score double, error_message string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        got = [(r.time_bucket, r.total_requests) for r in M.window_metrics(df).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [(dt.datetime(2026, 1, 1, 10, 0), 2)]


def test_model_store_follows_the_data(spark):
    base = tempfile.mkdtemp(prefix="kredo-store-")
    rows = [(float(i), "a" if i % 2 else "b", float(i > 5)) for i in range(12)]
    df = spark.createDataFrame(rows, "x double, c string, label double")
    one, two = os.path.join(base, "one"), os.path.join(base, "two")
    df.write.parquet(one)
    df.withColumn("label", 1 - df.label).write.parquet(two)
    versions = [SC.data_version(spark.read.parquet(p)) for p in (one, one, two)]
    assert versions[0] == versions[1] != versions[2]
    models = [SC.fit_or_load(spark.read.parquet(p), ["x"], ["c"], "k") for p in (one, one, two)]
    assert models[0] is models[1]
    signs = [m.stages[-1].coefficients[0] > 0 for m in models]
    assert signs == [True, True, False]
    SC._LOADED.clear()
    again = SC.fit_or_load(spark.read.parquet(one), ["x"], ["c"], "k")      # read from the store
    assert again.stages[-1].coefficients == models[0].stages[-1].coefficients
