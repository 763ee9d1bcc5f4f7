"""Queries: sources and sinks, each a write of table-derived data to the
shared checkpoint folder and a read back through the kredo source."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from kredo.functions.timeutil import as_of_col
from kredo.operators import drift as D
from kredo.operators import metrics as M
from kredo.plans import evaluation as EV
from kredo.plans import standins as S
from kredo.plans.common import register, rnd, rounded
from kredo.plans import drift as DR
from kredo.sources import files as FI
from kredo.sources import sinks as SK
from kredo.sources.tables import table
from kredo.streaming.monitor import work_dir


@register("csv_roundtrip", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def q_csv_roundtrip(spark, d):
    """S13 -> S1: whole documents (multi-line texts) exported as CSV and read
    back with encoding detection and an explicit schema."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    path = os.path.join(work_dir(spark, "csv"), "documents")
    SK.export_csv(docs, path)
    return FI.read_csv(spark, path, docs.schema, multi_line=True)


_LOG_COLS = ["log_id", "timestamp", "client_id", "prediction_type", "score", "latency_seconds",
             "error_message"]


@register("ndjson_logs", f"""WITH {S.SQL_API_LOGS}
SELECT log_id, "timestamp", client_id, prediction_type, {rnd('score')} AS score,
  {rnd('latency_seconds')} AS latency_seconds, error_message FROM api_logs""")
def q_ndjson_logs(spark, d):
    """S10 (NDJSON) -> S3: every log row as a JSON line, plus one malformed
    line per failed prediction (an unterminated object) and blank lines;
    the reader keeps exactly the well-formed rows."""
    logs = S.api_logs(spark, d).select(*_LOG_COLS)
    path = os.path.join(work_dir(spark, "ndjson"), "api.log")
    SK.write_ndjson(logs, path)
    bad = S.api_logs(spark, d).where(F.col("error_message").isNotNull()).select(
        F.concat(F.lit('{"log_id": '), F.col("log_id").cast("string"), F.lit(', "score": ')).alias("value"))
    bad.unionByName(bad.select(F.lit("").alias("value"))).write.mode("append").text(path)
    back = FI.read_ndjson_logs(spark, path)
    return rounded(back.select(*_LOG_COLS))


@register("log_table_scan", f"""WITH {S.SQL_API_LOGS}
SELECT log_id, "timestamp", client_id, {rnd('score')} AS score, {rnd('latency_seconds')} AS latency_seconds,
  CASE WHEN compute_device <> 'cpu' THEN {rnd('cpu_usage_pct')} END AS cpu_usage_pct,
  CASE WHEN compute_device <> 'cpu' THEN {rnd('gpu_usage_pct')} END AS gpu_usage_pct,
  CASE WHEN compute_device <> 'cpu' THEN compute_device END AS compute_device
FROM api_logs WHERE "timestamp" > TIMESTAMP '{S.AS_OF}' - INTERVAL 72 HOUR AND "timestamp" <= TIMESTAMP '{S.AS_OF}'""")
def q_log_table_scan(spark, d):
    """S10 (partitioned table, without the resource columns as an older
    writer would) -> S4/S5 (partition-pruned 72-hour scan, resource columns
    restored: present ones from a second, newer append)."""
    logs = S.api_logs(spark, d)
    path = os.path.join(work_dir(spark, "logtable"), "api_logs")
    old = logs.where(F.col("compute_device") == "cpu").drop("cpu_usage_pct", "gpu_usage_pct",
                                                           "gpu_memory_mb", "compute_device")
    SK.write_logs(old, path)
    SK.write_logs(logs.where(F.col("compute_device") != "cpu"), path)
    back = FI.read_log_table(spark, path, S.AS_OF, last_n_hours=72, merge_schema=True)
    return rounded(back.select("log_id", "timestamp", "client_id", "score", "latency_seconds",
                               "cpu_usage_pct", "gpu_usage_pct", "compute_device"))


@register("threshold_artifact", f"""WITH {S.SQL_SCORED}, {EV._CURVE}, {EV._OPT}
SELECT {rnd('optimal_threshold')} AS optimal_threshold FROM opt""")
def q_threshold_artifact(spark, d):
    """A21 -> S8: the optimal threshold written as a JSON artifact, read back
    by key."""
    opt = M.find_optimal_threshold(S.scored(spark, d)).select("optimal_threshold")
    path = os.path.join(work_dir(spark, "artifact"), "optimal_threshold.json")
    opt.write.json(path)
    t = FI.read_threshold(spark, path)
    return rounded(spark.range(1).select(F.lit(t).alias("optimal_threshold")))


@register("drift_record", f"""WITH {DR.LOG_DETAILS},
s AS (SELECT avg(change) AS drift_score, count(*) AS n_details,
  list_sort(list(feature) FILTER (WHERE status_code <> 'ok')) AS affected FROM details)
SELECT TIMESTAMP '{DR.LOG_AS_OF}' AS detection_time, drift_score > 0.05 AS is_drift_detected,
  {rnd('drift_score')} AS drift_score, array_to_string(affected, ',') AS affected_features,
  CAST(n_details AS INTEGER) AS n_details, '1.0' AS model_version,
  CASE WHEN drift_score > 0.05 THEN 'CRITICAL' END AS severity,
  CASE WHEN drift_score > 0.05 THEN printf('data drift detected (score %.4f)', drift_score) END AS message,
  CASE WHEN drift_score > 0.05 THEN false END AS acknowledged
FROM s""")
def q_drift_record(spark, d):
    """D3 -> S11, X3 -> S12: drift of the logged payloads, appended to the drift table,
    with its alert appended to the alerts; both read back."""
    from pyspark import StorageLevel

    from kredo.operators.alerts import drift_alert
    as_of = as_of_col(DR.LOG_AS_OF)
    det, _ = D.detect_drift(S.application_log(spark, d), S.applications(spark, d), DR.LOG_AS_OF, DR.LOG_HOURS)
    # the drift row, its details and the alert all read the comparison: it
    # has one row per feature, so it is computed once and kept
    det = det.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        summary = D.drift_verdict(det)
        base = work_dir(spark, "driftrec")
        SK.record_drift(summary, det, os.path.join(base, "drift"), as_of)
        SK.append_alerts(drift_alert(summary, as_of), os.path.join(base, "alerts"))
    finally:
        det.unpersist()
    alerts = spark.read.parquet(os.path.join(base, "alerts")).select(
        F.col("created_at").alias("detection_time"), "severity", "message", "acknowledged")
    return rounded(spark.read.parquet(os.path.join(base, "drift")).join(alerts, "detection_time", "left").select(
        "detection_time", "is_drift_detected", "drift_score", F.array_join("affected_features", ",").alias("affected_features"),
        F.json_array_length("details").alias("n_details"), "model_version", "severity", "message", "acknowledged"))
