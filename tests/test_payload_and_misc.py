import json

from pyspark.sql import functions as F

from kredo.functions.payload import client_id, field_groups, flatten, parse_object, payload_frame
from kredo.operators import drift as D
from kredo.operators.scoring import normalised_importance


def test_parse_and_frame(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "not json"), (3, "[1, 2]"), (4, "  "),
                                (5, '{"a": 2}')], "log_id long, input_data string")
    fr = payload_frame(df, keep=["log_id"])
    assert sorted(fr.columns) == ["a", "b", "log_id"]
    assert {r.log_id: (r.a, r.b) for r in fr.collect()} == {1: ("1", "x"), 5: ("2", None)}


def test_flatten_and_groups(spark):
    df = spark.createDataFrame([((1, (2.0, "z")),)], "s struct<a:int, inner:struct<b:double, c:string>>")
    assert flatten(df).columns == ["s.a", "s.inner.b", "s.inner.c"]
    logs = spark.createDataFrame([('{"CODE_GENDER": "F", "AMT_CREDIT": 10, "X": 1}',)], "input_data string")
    g = field_groups(logs).first()
    assert g.personal == {"CODE_GENDER": "F"} and g.financial == {"AMT_CREDIT": "10"} and g.work == {}


def test_client_id_fallthrough(spark):
    df = spark.createDataFrame([('{"SK_ID_CURR": 0, "client_id": 7}',), ('{"SK_ID_CURR": 5}',)], "p string")
    assert [r.c for r in df.select(client_id(parse_object("p")).alias("c")).collect()] == [7, 5]


def test_detect_drift_from_log(spark):
    logs = spark.createDataFrame(
        [(1, "2026-01-30 10:00:00", json.dumps({"AMT_CREDIT": 120.0, "CODE_GENDER": "F"})),
         (2, "2026-01-30 11:00:00", json.dumps({"AMT_CREDIT": 80.0, "CODE_GENDER": "F"})),
         (3, "2026-01-01 11:00:00", json.dumps({"AMT_CREDIT": 1e9, "CODE_GENDER": "M"}))],
        "log_id long, ts string, input_data string").select(
        "log_id", F.col("ts").cast("timestamp_ntz").alias("timestamp"), "input_data")
    ref = spark.createDataFrame([(100.0, "F"), (100.0, "M")], "AMT_CREDIT double, CODE_GENDER string")
    det, summ = D.detect_drift(logs, ref, as_of="2026-01-31 00:00:00", last_n_hours=48)
    d = {r.feature: r.change for r in det.collect()}
    assert d == {"AMT_CREDIT": 0.0, "CODE_GENDER": 1.0}
    s = summ.first()
    assert s.drift_score == 0.5 and s.has_drift and s.recent_sample_size == 2


def test_normalised_importance(spark):
    imp = spark.createDataFrame([("a", 3.0), ("b", float("nan")), ("c", 1.0)], "feature string, importance double")
    out = {r.feature: r.importance for r in normalised_importance(imp).collect()}
    assert out == {"a": 0.75, "b": 0.0, "c": 0.25}


def test_cluster_conf_sizes_partitions():
    from kredo.session import cluster_conf
    conf = cluster_conf(100 * (1 << 40), executor_cores=8, executors=1000)
    parts = int(conf["spark.sql.shuffle.partitions"])
    assert parts % 8000 == 0 and parts * (256 << 20) >= 100 * (1 << 40)
    assert int(cluster_conf(1 << 20, 4, 2)["spark.sql.shuffle.partitions"]) == 8
