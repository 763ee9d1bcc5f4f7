"""Queries: alerts, archive, cleanup and time helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kredo.functions import timeutil as T
from kredo.operators import alerts as AL
from kredo.operators import archive as AR
from kredo.plans import standins as S
from kredo.plans.common import register
from kredo.sources.tables import table

AS_OF = S.AS_OF
NOW = f"TIMESTAMP '{AS_OF}'"
CTE = f"WITH {S.SQL_API_LOGS}\n"

_ALERTS_SQL = f"""alerts AS (
  SELECT log_id * 10 + 2 AS alert_id, 'error_rate' AS alert_type, 'WARNING' AS severity,
    'batch item failed: ' || error_message AS message,
    CAST(to_json({{'log_id': log_id, 'client_id': client_id}}) AS VARCHAR) AS metadata,
    false AS acknowledged, "timestamp" AS created_at, "timestamp" AS updated_at
  FROM api_logs WHERE prediction_type = 'batch' AND error_message IS NOT NULL
  UNION ALL
  SELECT log_id * 10 + 1, 'latency', 'INFO', printf('latency %.3f s above %.1f s', latency_seconds, 0.3),
    CAST(to_json({{'log_id': log_id, 'client_id': client_id}}) AS VARCHAR), false, "timestamp", "timestamp"
  FROM api_logs WHERE latency_seconds > 0.3)"""
LATENCY_LIMIT = 0.3


def _alerts(spark, d):
    return AL.log_alerts(S.api_logs(spark, d), latency_limit_s=LATENCY_LIMIT)


@register("alert_rules", CTE + f", {_ALERTS_SQL}\nSELECT alert_id, alert_type, severity, message, metadata, created_at FROM alerts")
def q_alert_rules(spark, d):
    return _alerts(spark, d).select("alert_id", "alert_type", "severity", "message", "metadata",
                                    "created_at")


# Acknowledgement stand-in: every alert older than 7 days at as_of is
# acknowledged one day after it was raised.
ACK_AFTER_DAYS = 7


def _events(spark, d):
    old = F.col("created_at") < T.as_of_col(AS_OF) - F.expr(f"INTERVAL {ACK_AFTER_DAYS} DAYS")
    return AL.with_acks(_alerts(spark, d), old, F.col("created_at") + F.expr("INTERVAL 1 DAY"))


_STATE_SQL = f"""{_ALERTS_SQL},
acks AS (SELECT alert_id, alert_type, severity, message, metadata, true AS acknowledged, created_at,
  created_at + INTERVAL 1 DAY AS updated_at FROM alerts WHERE created_at < {NOW} - INTERVAL {ACK_AFTER_DAYS} DAY),
ev AS (SELECT * FROM alerts UNION ALL SELECT * FROM acks),
state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id
  ORDER BY updated_at DESC, acknowledged DESC) AS rk FROM ev) WHERE rk = 1)"""


@register("alert_state", CTE + f""", {_STATE_SQL}
SELECT alert_id, alert_type, severity, acknowledged, created_at, updated_at FROM state""")
def q_alert_state(spark, d):
    return AL.alert_state(_events(spark, d)).select(
        "alert_id", "alert_type", "severity", "acknowledged", "created_at", "updated_at")


@register("recent_alerts", CTE + f""", {_STATE_SQL}
SELECT alert_id, alert_type, severity, message, created_at, json_extract_string(metadata, '$.client_id') AS client_id
FROM state WHERE NOT acknowledged ORDER BY created_at DESC, alert_id DESC LIMIT 20""")
def q_recent_alerts(spark, d):
    r = AL.recent_alerts(AL.alert_state(_events(spark, d)), limit=20, unacknowledged_only=True)
    return r.select("alert_id", "alert_type", "severity", "message", "created_at",
                    F.col("metadata_map")["client_id"].alias("client_id"))


@register("alert_cleanup", CTE + f""", {_STATE_SQL}
SELECT alert_type, count(CASE WHEN created_at >= {NOW} - INTERVAL 14 DAY THEN 1 END) AS kept,
  count(CASE WHEN created_at < {NOW} - INTERVAL 14 DAY THEN 1 END) AS deleted
FROM state GROUP BY alert_type""")
def q_alert_cleanup(spark, d):
    return AL.cleanup_counts(AL.alert_state(_events(spark, d)), T.as_of_col(AS_OF), days=14)


# Archive stand-in: the archive already holds the rows older than 21 days
# (a previous run); this run archives everything older than 14 days.
PREVIOUS_DAYS, ARCHIVE_DAYS = 21, 14


def _archive(spark, d):
    live = S.api_logs(spark, d)
    now = T.as_of_col(AS_OF)
    previous = live.where(F.col("timestamp") < now - F.expr(f"INTERVAL {PREVIOUS_DAYS} DAYS"))
    return AR.archive_plan(live, previous, now - F.expr(f"INTERVAL {ARCHIVE_DAYS} DAYS"),
                           archived_at=now)


@register("archive_split", CTE + f"""SELECT log_id, "timestamp", 'periodic_archive' AS archive_reason,
  {NOW} AS archived_at
FROM api_logs WHERE "timestamp" < {NOW} - INTERVAL {ARCHIVE_DAYS} DAY
  AND log_id NOT IN (SELECT log_id FROM api_logs WHERE "timestamp" < {NOW} - INTERVAL {PREVIOUS_DAYS} DAY)""")
def q_archive_split(spark, d):
    to_archive, _ = _archive(spark, d)
    return to_archive.select("log_id", "timestamp", "archive_reason", "archived_at")


@register("archive_counts", CTE + f"""SELECT
  count(CASE WHEN "timestamp" < {NOW} - INTERVAL {ARCHIVE_DAYS} DAY
             AND "timestamp" >= {NOW} - INTERVAL {PREVIOUS_DAYS} DAY THEN 1 END) AS archived_count,
  count(CASE WHEN NOT ("timestamp" < {NOW} - INTERVAL {ARCHIVE_DAYS} DAY) THEN 1 END) AS remaining_count
FROM api_logs""")
def q_archive_counts(spark, d):
    to_archive, remaining = _archive(spark, d)
    return (to_archive.agg(F.count(F.lit(1)).alias("archived_count"))
            .select("archived_count", remaining.agg(F.count(F.lit(1))).scalar().alias("remaining_count")))


@register("days_from_date", f"""SELECT o_orderkey AS SK_ID_CURR,
  coalesce(CAST(datediff('day', DATE '{S.DAY_ZERO}', TRY_CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE)) AS INTEGER), -15000) AS DAYS_BIRTH,
  coalesce(CAST(datediff('day', DATE '{S.DAY_ZERO}', TRY_CAST(o_orderpriority AS DATE)) AS INTEGER), -500) AS DAYS_EMPLOYED,
  CAST(DATE '{S.DAY_ZERO}' + CAST(datediff('day', DATE '{S.DAY_ZERO}', CAST(o_orderdate AS DATE)) AS INTEGER) AS DATE) AS birth_date
FROM orders""")
def q_days_from_date(spark, d):
    o = table(spark, d, "orders")
    day0 = F.lit(S.DAY_ZERO).cast("timestamp_ntz")
    birth = T.date_to_days(F.date_format("o_orderdate", "yyyy-MM-dd"), day0, -15000)
    emp = T.date_to_days(F.col("o_orderpriority"), day0, -500)
    return o.select(F.col("o_orderkey").alias("SK_ID_CURR"), birth.alias("DAYS_BIRTH"),
                    emp.alias("DAYS_EMPLOYED"),
                    T.days_to_date(birth, day0).alias("birth_date"))


@register("local_time", """SELECT event_id AS log_id,
  timezone('Europe/Paris', timezone('UTC', ts)) AS local_ts,
  CAST(timezone('Europe/Paris', timezone('UTC', ts)) AS DATE) AS local_date
FROM events""")
def q_local_time(spark, d):
    e = table(spark, d, "events")
    lt = T.to_local_naive(F.col("ts"))
    return e.select(F.col("event_id").alias("log_id"), lt.alias("local_ts"), F.to_date(lt).alias("local_date"))


@register("anomaly_alerts", CTE + f""", p AS (
  SELECT quantile_cont(latency_seconds, 0.95) AS p95 FROM api_logs
  WHERE "timestamp" > {NOW} - INTERVAL 24 HOUR AND "timestamp" <= {NOW})
SELECT log_id * 10 + 4 AS alert_id, 'anomaly' AS alert_type, 'WARNING' AS severity,
  "timestamp" AS created_at
FROM api_logs, p
WHERE latency_seconds > p95 AND "timestamp" > {NOW} - INTERVAL 24 HOUR AND "timestamp" <= {NOW}""")
def q_anomaly_alerts(spark, d):
    """D5 -> X3: a WARNING ``anomaly`` alert per latency anomaly of the day."""
    from kredo.operators.logstats import latency_anomalies
    alerts = AL.anomaly_alerts(latency_anomalies(S.api_logs(spark, d), AS_OF, hours=24))
    return alerts.select("alert_id", "alert_type", "severity", "created_at")
