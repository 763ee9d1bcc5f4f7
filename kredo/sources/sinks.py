"""Sinks (S10-S14).  Every writer appends or writes a new folder; none
rewrites a path it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_logs(logs: DataFrame, path: str) -> None:
    """Append prediction-log rows, partitioned by day, payload as JSON
    text (structs/maps are serialised with ``to_json``)."""
    out = logs
    if "input_data" in logs.columns and logs.schema["input_data"].dataType.typeName() != "string":
        out = out.withColumn("input_data", F.to_json("input_data"))
    # REBALANCE: AQE groups rows by day (few files per day) and splits a hot
    # day across tasks instead of writing it from one
    out.withColumn("log_date", F.to_date("timestamp")).hint("rebalance", "log_date") \
        .write.mode("append").partitionBy("log_date").parquet(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    """NDJSON log lines (timestamps as ISO text)."""
    df.write.mode("append").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def drift_row(summary: DataFrame, details: DataFrame, as_of, model_version: str = "1.0") -> DataFrame:
    """One drift row (array of affected features + JSON details).  The
    details table has one row per feature - bounded by the schema - so
    folding it into the row is safe."""
    det = details.agg(F.to_json(F.collect_list(F.struct(
        "feature", "change_pct", "status_code"))).alias("details")).scalar()
    return summary.select(as_of.alias("detection_time"), F.col("has_drift").alias("is_drift_detected"),
                          "drift_score", "affected_features", det.alias("details"),
                          F.lit(model_version).alias("model_version"))


def record_drift(summary: DataFrame, details: DataFrame, path: str, as_of,
                 model_version: str = "1.0") -> None:
    """``drift_row`` appended to the drift table."""
    drift_row(summary, details, as_of, model_version).write.mode("append").parquet(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append alert events."""
    alerts.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with header, one for each task."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines export."""
    df.write.mode("overwrite").json(path)
