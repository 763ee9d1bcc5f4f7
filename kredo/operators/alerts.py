"""Alerts as an append-only event table.

An alert is never updated in place: raising it appends a ``raised`` event,
acknowledging it appends an ``ack`` event; the current state of every alert
is the latest event per ``alert_id`` (``max_by`` - an aggregate, so no
window buffers an alert's history).  Rule outputs are produced per row with
``explode(array_compact(array(struct...)))``: no join, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Declared alert types and severities.
ALERT_TYPES = ("latency", "error_rate", "drift", "anomaly")
SEVERITIES = ("INFO", "WARNING", "CRITICAL")
TYPE_CODE = {t: i + 1 for i, t in enumerate(ALERT_TYPES)}
EVENT_COLUMNS = ["alert_id", "alert_type", "severity", "message", "metadata",
                 "acknowledged", "created_at", "updated_at"]


def _alert(kind: str, severity: str, message: Column, alert_id: Column,
           metadata: Column, when: Column) -> Column:
    return F.when(when, F.struct(
        alert_id.alias("alert_id"), F.lit(kind).alias("alert_type"),
        F.lit(severity).alias("severity"), message.alias("message"),
        metadata.alias("metadata")))


def log_alerts(logs: DataFrame, latency_limit_s: float = 1.0) -> DataFrame:
    """X3 over the prediction log: a failed batch item raises a WARNING
    ``error_rate`` alert; a latency above ``latency_limit_s`` an INFO
    ``latency`` alert.  Alert id = log_id * 10 + type code (stable)."""
    meta = F.to_json(F.struct("log_id", "client_id"))
    rules = F.array_compact(F.array(
        _alert("error_rate", "WARNING",
               F.concat(F.lit("batch item failed: "), F.col("error_message")),
               F.col("log_id") * 10 + TYPE_CODE["error_rate"], meta,
               (F.col("prediction_type") == "batch") & F.col("error_message").isNotNull()),
        _alert("latency", "INFO",
               F.format_string("latency %.3f s above %.1f s", F.col("latency_seconds"),
                               F.lit(latency_limit_s)),
               F.col("log_id") * 10 + TYPE_CODE["latency"], meta,
               F.col("latency_seconds") > F.lit(latency_limit_s)),
    ))
    return (logs.select(F.explode(rules).alias("a"), F.col("timestamp").alias("created_at"))
            .select("a.*", F.lit(False).alias("acknowledged"), "created_at",
                    F.col("created_at").alias("updated_at")))


def drift_alert(summary: DataFrame, as_of: Column, model_version: str = "1.0") -> DataFrame:
    """A CRITICAL ``drift`` alert when the drift summary says so.  Its id
    is a hash of type, time and model version: one alert for each detection."""
    return summary.where(F.col("has_drift")).select(
        F.xxhash64(F.lit("drift"), as_of.cast("string"), F.lit(model_version)).alias("alert_id"),
        F.lit("drift").alias("alert_type"), F.lit("CRITICAL").alias("severity"),
        F.format_string("data drift detected (score %.4f)", F.col("drift_score")).alias("message"),
        F.to_json(F.struct("drift_score", "affected_features",
                           F.lit(model_version).alias("model_version"))).alias("metadata"),
        F.lit(False).alias("acknowledged"), as_of.alias("created_at"), as_of.alias("updated_at"))


def ack_events(alerts: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Acknowledgement events for the alert ids in ``ids``."""
    base = alerts.join(ids.select("alert_id").distinct(), "alert_id", "left_semi")
    return base.select(*[F.col(c) for c in EVENT_COLUMNS if c not in ("acknowledged", "updated_at")],
                       F.lit(True).alias("acknowledged"), at.alias("updated_at")) \
        .select(*EVENT_COLUMNS)


def with_acks(alerts: DataFrame, when: Column, at: Column) -> DataFrame:
    """X2 for a rule: every alert's event and, where ``when`` holds, its
    acknowledgement at ``at`` - in one pass over the alerts, without a join."""
    kept = [F.col(c) for c in EVENT_COLUMNS if c not in ("acknowledged", "updated_at")]
    raised = F.struct(*kept, F.col("acknowledged"), F.col("updated_at"))
    acked = F.struct(*kept, F.lit(True).alias("acknowledged"), at.alias("updated_at"))
    events = F.when(when, F.array(raised, acked)).otherwise(F.array(raised))
    return alerts.select(F.explode(events).alias("e")).select("e.*")


def alert_state(events: DataFrame) -> DataFrame:
    """Latest event per alert (ties: an ack wins)."""
    latest = F.max_by(F.struct(*[c for c in EVENT_COLUMNS if c != "alert_id"]),
                      F.struct("updated_at", "acknowledged"))
    return events.groupBy("alert_id").agg(latest.alias("s")).select("alert_id", "s.*")


def recent_alerts(state: DataFrame, limit: int = 10, unacknowledged_only: bool = False) -> DataFrame:
    """Newest alerts first, metadata parsed to a map."""
    s = state.where(~F.col("acknowledged")) if unacknowledged_only else state
    return (s.orderBy(F.col("created_at").desc(), F.col("alert_id").desc()).limit(limit)
            .withColumn("metadata_map", F.from_json("metadata", "map<string,string>")))


def cleanup_alerts(state: DataFrame, as_of: Column, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted) by ``created_at`` against a fixed cutoff."""
    cutoff = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return state.where(F.col("created_at") >= cutoff), state.where(F.col("created_at") < cutoff)


def apply_cleanup(store, as_of: str, days: int = 90, table: str = "alert_events") -> dict:
    """U2 applied: delete the events of alerts raised more than ``days`` before
    ``as_of`` from a versioned table partitioned by ``created_date``.  Whole days go
    by the manifest alone, unread; the cutoff's own day is written anew; later days
    are not touched.  Returns {deleted, version}."""
    from datetime import datetime, timedelta

    from kredo.operators.archive import days_before
    cutoff = datetime.fromisoformat(as_of) - timedelta(days=days)
    change = store.change()
    whole, partly = days_before(store, table, cutoff)
    deleted = change.drop(table, whole)
    if partly:
        before = sum(n for p in partly for n in change.base["tables"][table]["parts"][p].values())
        kept = store.read(table, partly).where(F.col("created_at") >= F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz"))
        deleted += before - sum(change.replace(table, kept, "created_date", partly).values())
    if deleted:
        change.publish()
    return {"deleted": deleted, "version": store.manifest()["version"]}


def cleanup_counts(state: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """U2 as a report: alerts kept and deleted by type, in one pass."""
    cutoff = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return state.groupBy("alert_type").agg(F.count_if(F.col("created_at") >= cutoff).alias("kept"),
                                           F.count_if(F.col("created_at") < cutoff).alias("deleted"))


def anomaly_alerts(anomalies: DataFrame) -> DataFrame:
    """X3 for the declared ``anomaly`` type: one WARNING per latency anomaly
    (D5 rows: latency above the window's p95)."""
    return anomalies.select(
        (F.col("log_id") * 10 + TYPE_CODE["anomaly"]).alias("alert_id"),
        F.lit("anomaly").alias("alert_type"), F.lit("WARNING").alias("severity"),
        F.format_string("latency %.3f s is %.2f%% of p95", F.col("latency_seconds"),
                        F.col("pct_of_p95")).alias("message"),
        F.to_json(F.struct("log_id", "client_id", "p95_latency")).alias("metadata"),
        F.lit(False).alias("acknowledged"), F.col("timestamp").alias("created_at"),
        F.col("timestamp").alias("updated_at"))
