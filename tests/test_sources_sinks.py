import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from kredo.operators.alerts import alert_state, ack_events, cleanup_alerts, log_alerts, recent_alerts
from kredo.operators.archive import archive_logs
from kredo.sources import files as FI
from kredo.sources import sinks as SK


def test_csv_encoding_fallback(spark):
    d = tempfile.mkdtemp(prefix="kredo-test-")
    utf = os.path.join(d, "utf.csv")
    lat = os.path.join(d, "latin.csv")
    with open(utf, "w", encoding="utf-8") as f:
        f.write("id,nom,valeur\n1,Élodie,3.5\n2,Zoë,4\n")
    with open(lat, "w", encoding="latin-1") as f:
        f.write("id,lieu\n1,Café\n2,Crème\n")
    assert {k: [os.path.basename(p) for p in v] for k, v in FI.file_encodings(spark, d).items()} == \
        {"UTF-8": ["utf.csv"], "ISO-8859-1": ["latin.csv"]}
    assert [r.lieu for r in FI.read_csv(spark, lat, "id int, lieu string").orderBy("id").collect()] == ["Café", "Crème"]
    assert FI.read_csv(spark, utf).schema["valeur"].dataType.typeName() == "double"
    cat = FI.load_catalog(spark, d, files=["latin.csv", "absent.csv"])
    assert set(cat) == {"latin"}


def test_csv_folder_of_mixed_encodings(spark):
    d = tempfile.mkdtemp(prefix="kredo-test-")
    for name, enc, rows in (("a", "utf-8", "1,Café,3\n2,Zoë,4\n"), ("b", "latin-1", "3,Crème,2.5\n")):
        with open(os.path.join(d, f"{name}.csv"), "w", encoding=enc) as f:
            f.write("id,lieu,x\n" + rows)
    got = FI.read_csv(spark, d)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "Café", 3.0), (2, "Zoë", 4.0), (3, "Crème", 2.5)]


def test_ndjson_malformed_and_missing(spark):
    d = tempfile.mkdtemp(prefix="kredo-test-")
    p = os.path.join(d, "api.log")
    with open(p, "w") as f:
        f.write('{"timestamp": "2026-01-02T10:00:00", "score": 0.4, "latency_seconds": 0.1}\n\n')
        f.write('{"timestamp": "2026-01-02T11:00:00", "score": \n')
        f.write('{"timestamp": "2026-01-02T12:00:00", "score": 0.6, "latency_seconds": 0.2}\n')
    df = FI.read_ndjson_logs(spark, p)
    assert df.count() == 2 and df.schema["timestamp"].dataType.typeName() == "timestamp_ntz"
    assert FI.read_ndjson_logs(spark, os.path.join(d, "none.log")).count() == 0


def test_threshold_artifact(spark):
    d = tempfile.mkdtemp(prefix="kredo-test-")
    p = os.path.join(d, "t.json")
    with open(p, "w") as f:
        f.write('{"optimal_threshold": 0.5099999999999998}')
    assert FI.read_threshold(spark, p) == 0.5099999999999998
    assert FI.read_threshold(spark, os.path.join(d, "absent.json")) == 0.5


def test_json_array_samples(spark):
    d = tempfile.mkdtemp(prefix="kredo-test-")
    p = os.path.join(d, "sample.json")
    with open(p, "w") as f:
        f.write('[{"description": "a", "data": {"SK_ID_CURR": 1, "AMT_CREDIT": 10.5}},'
                ' {"description": "b", "data": {"SK_ID_CURR": 2, "AMT_CREDIT": 20.0}}]')
    df = FI.read_json_array(spark, p)
    assert sorted(df.columns) == ["AMT_CREDIT", "SK_ID_CURR", "description"] and df.count() == 2


LOGS = ("log_id long, timestamp timestamp_ntz, client_id long, prediction_type string, "
        "input_data string, score double, latency_seconds double, error_message string")


def _logs(spark):
    base = dt.datetime(2026, 1, 31)
    return spark.createDataFrame(
        [(i, base - dt.timedelta(days=i), i, "batch" if i % 2 else "single", "{}", 0.1,
          1.5 if i == 3 else 0.1, "err" if i % 3 == 0 else None) for i in range(1, 41)], LOGS)


def test_archive_is_idempotent(spark):
    d = tempfile.mkdtemp(prefix="kredo-test-")
    live0 = os.path.join(d, "live0")
    SK.write_logs(_logs(spark), live0)
    arch = os.path.join(d, "archive")
    r1 = archive_logs(spark, live0, arch, os.path.join(d, "live1"), "2026-01-31 00:00:00", days=30)
    assert r1 == {"archived": 10, "remaining": 30}
    # re-running on the same input adds nothing to the archive
    r2 = archive_logs(spark, live0, arch, os.path.join(d, "live2"), "2026-01-31 00:00:00", days=30)
    assert r2 == {"archived": 0, "remaining": 30}
    assert spark.read.parquet(arch).count() == 10
    # the next period moves the next rows; days = 0 moves everything older than as_of
    r3 = archive_logs(spark, os.path.join(d, "live1"), arch, os.path.join(d, "live3"),
                      "2026-01-31 00:00:00", days=0)
    assert r3 == {"archived": 30, "remaining": 0}
    try:
        archive_logs(spark, live0, arch, live0, "2026-01-31 00:00:00")
        raise AssertionError("overwriting the input must be refused")
    except ValueError:
        pass


def test_alert_lifecycle(spark):
    alerts = log_alerts(_logs(spark), latency_limit_s=1.0)
    kinds = {(r.alert_type, r.severity) for r in alerts.collect()}
    assert kinds == {("error_rate", "WARNING"), ("latency", "INFO")}
    acks = ack_events(alerts, alerts.where(F.col("alert_type") == "latency"),
                      F.lit(dt.datetime(2026, 2, 1)).cast("timestamp_ntz"))
    state = alert_state(alerts.unionByName(acks))
    assert state.where("acknowledged").count() == 1
    un = recent_alerts(state, limit=3, unacknowledged_only=True).collect()
    assert len(un) == 3 and all(not r.acknowledged for r in un)
    kept, deleted = cleanup_alerts(state, F.lit("2026-01-31 00:00:00").cast("timestamp_ntz"), days=20)
    assert kept.count() + deleted.count() == state.count()


def test_nan_becomes_null_at_sources(spark):
    d = tempfile.mkdtemp(prefix="kredo-test-")
    p = os.path.join(d, "nan.csv")
    with open(p, "w") as f:
        f.write("id,x\n1,NaN\n2,1.5\n")
    got = {r.id: r.x for r in FI.read_csv(spark, p, "id int, x double").collect()}
    assert got == {1: None, 2: 1.5}


def test_json_text_keeps_nulls_and_json_export(spark):
    from kredo.functions.payload import to_json_text
    df = spark.createDataFrame([(1, None, 0.5)], "id long, name string, score double")
    assert df.select(to_json_text("id", "name", "score").alias("j")).first().j == \
        '{"id":1,"name":null,"score":0.5}'
    d = tempfile.mkdtemp(prefix="kredo-test-")
    imp = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "feature string, importance double")
    SK.export_json(imp, os.path.join(d, "imp"))
    back = spark.read.json(os.path.join(d, "imp"))
    assert sorted((r.feature, r.importance) for r in back.collect()) == [("a", 0.75), ("b", 0.25)]
