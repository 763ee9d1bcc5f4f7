"""Queries over the prediction log (stand-in: ``events``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kredo.functions import bands as B
from kredo.operators import history as H
from kredo.operators import logstats as L
from kredo.plans import standins as S
from kredo.plans.common import register, rnd, rounded
from kredo.sources.tables import table

AS_OF = S.AS_OF
AS_OF_DAY = "2024-01-30 18:00:00"    # mid-day instant for the "today" counter
NOW = f"TIMESTAMP '{AS_OF}'"
CTE = f"WITH {S.SQL_API_LOGS}\n"


def logs(spark, d):
    return S.api_logs(spark, d)


def _win(hours: int, now: str = NOW) -> str:
    return f'"timestamp" > {now} - INTERVAL {hours} HOUR AND "timestamp" <= {now}'


@register("last_24h_stats", CTE + f"""SELECT count(*) AS total_predictions,
  count(CASE WHEN error_message IS NULL THEN 1 END) AS successful_predictions,
  count(CASE WHEN error_message IS NOT NULL THEN 1 END) AS failed_predictions,
  {rnd('avg(latency_seconds)', 4)} AS avg_latency_seconds,
  {rnd('min(latency_seconds)')} AS min_latency_seconds,
  {rnd('max(latency_seconds)')} AS max_latency_seconds,
  {rnd('avg(score)', 4)} AS avg_score, {rnd('min(score)')} AS min_score, {rnd('max(score)')} AS max_score,
  {rnd("100.0 * count(CASE WHEN error_message IS NOT NULL THEN 1 END) / nullif(count(*), 0)", 2)} AS error_rate_pct
FROM api_logs WHERE {_win(24)}""")
def q_last_24h_stats(spark, d):
    return rounded(L.last_24h_stats(logs(spark, d), AS_OF))


@register("prediction_stats", CTE + f"""SELECT count(*) AS total,
  count(CASE WHEN error_message IS NULL THEN 1 END) AS successful,
  count(CASE WHEN error_message IS NOT NULL THEN 1 END) AS failed,
  {rnd('coalesce(avg(score), 0.0)')} AS avg_score, {rnd('coalesce(min(score), 0.0)')} AS min_score,
  {rnd('coalesce(max(score), 0.0)')} AS max_score,
  {rnd('coalesce(avg(latency_seconds), 0.0)')} AS avg_latency_seconds,
  {rnd('coalesce(min(latency_seconds), 0.0)')} AS min_latency_seconds,
  {rnd('coalesce(max(latency_seconds), 0.0)')} AS max_latency_seconds,
  {rnd('coalesce(quantile_cont(latency_seconds, 0.95), 0.0)')} AS p95_latency_seconds,
  {rnd('coalesce(quantile_cont(latency_seconds, 0.99), 0.0)')} AS p99_latency_seconds,
  {rnd('coalesce(avg(cpu_usage_pct), 0.0)')} AS avg_cpu_usage_pct,
  {rnd('coalesce(max(cpu_usage_pct), 0.0)')} AS max_cpu_usage_pct,
  {rnd('coalesce(avg(gpu_usage_pct), 0.0)')} AS avg_gpu_usage_pct,
  {rnd('coalesce(max(gpu_usage_pct), 0.0)')} AS max_gpu_usage_pct,
  {rnd('coalesce(avg(gpu_memory_mb), 0.0)')} AS avg_gpu_memory_mb,
  {rnd("100.0 * count(CASE WHEN error_message IS NOT NULL THEN 1 END) / greatest(count(*), 1)", 2)} AS error_rate_pct
FROM api_logs WHERE {_win(720)}""")
def q_prediction_stats(spark, d):
    return rounded(L.prediction_stats(logs(spark, d), AS_OF, last_n_hours=720))


@register("frame_stats", CTE + f"""SELECT count(*) AS total,
  count(CASE WHEN error_message IS NULL THEN 1 END) AS successful,
  count(CASE WHEN error_message IS NOT NULL THEN 1 END) AS failed,
  {rnd('coalesce(avg(score), 0.0)')} AS avg_score, {rnd('coalesce(min(score), 0.0)')} AS min_score,
  {rnd('coalesce(max(score), 0.0)')} AS max_score,
  {rnd('avg(latency_seconds)')} AS avg_latency_seconds,
  {rnd('avg(cpu_usage_pct)')} AS avg_cpu_usage_pct, {rnd('avg(gpu_usage_pct)')} AS avg_gpu_usage_pct,
  {rnd('avg(gpu_memory_mb)')} AS avg_gpu_memory_mb,
  {rnd("100.0 * count(CASE WHEN error_message IS NOT NULL THEN 1 END) / nullif(count(*), 0)", 2)} AS error_rate_pct,
  count(CASE WHEN "timestamp" >= CAST(CAST(TIMESTAMP '{AS_OF_DAY}' AS DATE) AS TIMESTAMP) THEN 1 END) AS today_count
FROM api_logs WHERE {_win(720, f"TIMESTAMP '{AS_OF_DAY}'")}""")
def q_frame_stats(spark, d):
    return rounded(L.frame_stats(logs(spark, d), AS_OF_DAY, hours=720))


@register("log_summary_by_type", CTE + f""", lab AS (SELECT * FROM (VALUES ('single'), ('batch'), ('combined')) t(label))
SELECT label, count(a.log_id) AS total,
  {rnd('avg(score)')} AS avg_score, {rnd('min(score)')} AS min_score, {rnd('max(score)')} AS max_score,
  {rnd('stddev_samp(score)')} AS std_score,
  count(CASE WHEN score > 0.6 THEN 1 END) AS high_risk,
  count(CASE WHEN score > 0.45 AND score <= 0.6 THEN 1 END) AS medium_risk,
  count(CASE WHEN score <= 0.45 THEN 1 END) AS low_risk,
  {rnd('avg(latency_seconds) * 1000')} AS avg_latency_ms,
  {rnd('max(latency_seconds) * 1000')} AS max_latency_ms,
  count(CASE WHEN "timestamp" > {NOW} - INTERVAL 1 HOUR AND "timestamp" <= {NOW} THEN 1 END) AS last_hour
FROM lab LEFT JOIN api_logs a ON lab.label = 'combined' OR a.prediction_type = lab.label
GROUP BY label""")
def q_log_summary_by_type(spark, d):
    return rounded(L.stats_by_type(logs(spark, d), AS_OF))


@register("score_distribution", CTE + f"""SELECT
  CASE WHEN score < 0.2 THEN '0.0-0.2 (Very Low Risk)' WHEN score < 0.4 THEN '0.2-0.4 (Low Risk)'
       WHEN score < 0.6 THEN '0.4-0.6 (Medium Risk)' WHEN score < 0.8 THEN '0.6-0.8 (High Risk)'
       ELSE '0.8-1.0 (Very High Risk)' END AS risk_bucket,
  count(*) AS count,
  {rnd(f"100.0 * count(*) / nullif((SELECT count(*) FROM api_logs WHERE {_win(168)}), 0)", 2)} AS percentage
FROM api_logs WHERE {_win(168)} GROUP BY 1""")
def q_score_distribution(spark, d):
    return rounded(L.score_distribution(logs(spark, d), AS_OF, days=7))


@register("score_distribution_all", CTE + f"""SELECT
  CASE WHEN score < 0.2 THEN '0.0-0.2 (Very Low Risk)' WHEN score < 0.4 THEN '0.2-0.4 (Low Risk)'
       WHEN score < 0.6 THEN '0.4-0.6 (Medium Risk)' WHEN score < 0.8 THEN '0.6-0.8 (High Risk)'
       ELSE '0.8-1.0 (Very High Risk)' END AS risk_bucket,
  count(*) AS count, {rnd("100.0 * count(*) / nullif((SELECT count(*) FROM api_logs), 0)", 2)} AS percentage
FROM api_logs WHERE {_win(168)} GROUP BY 1""")
def q_score_distribution_all(spark, d):
    """The week's buckets as shares of the whole table."""
    return rounded(L.score_distribution(logs(spark, d), AS_OF, days=7, denominator="all"))


@register("score_histogram", CTE + """SELECT CAST(least(floor(score * 50), 49) AS INTEGER) AS bin,
  least(floor(score * 50), 49) / 50 AS bin_start, (least(floor(score * 50), 49) + 1) / 50 AS bin_end,
  count(*) AS count
FROM api_logs WHERE score IS NOT NULL GROUP BY 1, 2, 3""")
def q_score_histogram(spark, d):
    return rounded(L.score_histogram(logs(spark, d)))


@register("latency_box", CTE + f""", q AS (
  SELECT prediction_type, quantile_cont(latency_seconds, 0.25) AS q1,
         quantile_cont(latency_seconds, 0.5) AS median, quantile_cont(latency_seconds, 0.75) AS q3
  FROM api_logs WHERE latency_seconds IS NOT NULL GROUP BY 1)
SELECT prediction_type, {rnd('q1')} AS q1, {rnd('median')} AS median, {rnd('q3')} AS q3,
  {rnd('q3 - q1')} AS iqr,
  {rnd('min(CASE WHEN latency_seconds >= q1 - 1.5 * (q3 - q1) THEN latency_seconds END)')} AS lower_whisker,
  {rnd('max(CASE WHEN latency_seconds <= q3 + 1.5 * (q3 - q1) THEN latency_seconds END)')} AS upper_whisker,
  count(CASE WHEN latency_seconds < q1 - 1.5 * (q3 - q1) OR latency_seconds > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers,
  count(latency_seconds) AS n
FROM api_logs JOIN q USING (prediction_type) GROUP BY prediction_type, q1, median, q3""")
def q_latency_box(spark, d):
    return rounded(L.box_stats(logs(spark, d), "latency_seconds", ["prediction_type"]))


@register("hourly_performance", CTE + f"""SELECT date_trunc('hour', "timestamp") AS time_bucket,
  count(*) AS total_requests,
  {rnd('avg(latency_seconds)')} AS avg_latency_seconds, {rnd('min(latency_seconds)')} AS min_latency_seconds,
  {rnd('max(latency_seconds)')} AS max_latency_seconds,
  {rnd('quantile_cont(latency_seconds, 0.95)')} AS p95_latency_seconds,
  {rnd('quantile_cont(latency_seconds, 0.99)')} AS p99_latency_seconds,
  count(CASE WHEN error_message IS NOT NULL THEN 1 END) AS error_count,
  {rnd('100.0 * count(CASE WHEN error_message IS NOT NULL THEN 1 END) / count(*)')} AS error_rate,
  {rnd('avg(score)')} AS avg_score, {rnd('min(score)')} AS min_score, {rnd('max(score)')} AS max_score
FROM api_logs GROUP BY 1""")
def q_hourly_performance(spark, d):
    return rounded(L.hourly_performance(logs(spark, d)))


@register("latency_anomalies", CTE + f""", p AS (
  SELECT quantile_cont(latency_seconds, 0.95) AS p95 FROM api_logs WHERE {_win(24)})
SELECT log_id, "timestamp", client_id, {rnd('score')} AS score, {rnd('latency_seconds')} AS latency_seconds,
  {rnd('p95')} AS p95_latency, {rnd('100.0 * latency_seconds / p95', 2)} AS pct_of_p95
FROM api_logs, p WHERE latency_seconds > p95 AND {_win(24)}""")
def q_latency_anomalies(spark, d):
    return rounded(L.latency_anomalies(logs(spark, d), AS_OF, hours=24))


@register("type_split_counts", CTE + """SELECT prediction_type, count(*) AS total,
  count(CASE WHEN error_message IS NULL THEN 1 END) AS successful,
  count(CASE WHEN error_message IS NOT NULL THEN 1 END) AS failed
FROM api_logs GROUP BY 1""")
def q_type_split_counts(spark, d):
    return L.type_split_counts(logs(spark, d))


@register("batch_summary", CTE + f"""SELECT client_id, CAST("timestamp" AS DATE) AS batch_date,
  count(*) AS total, count(CASE WHEN error_message IS NOT NULL THEN 1 END) AS failed,
  {rnd('avg(score)', 4)} AS avg_score, {rnd('sum(latency_seconds)')} AS total_latency_seconds
FROM api_logs WHERE prediction_type = 'batch' GROUP BY 1, 2""")
def q_batch_summary(spark, d):
    return rounded(L.batch_summary(logs(spark, d)))


DEFAULT_THRESHOLD = 0.5


@register("risk_bands", CTE + f"""SELECT log_id,
  CASE WHEN score < 0.2 THEN '0.0-0.2 (Very Low Risk)' WHEN score < 0.4 THEN '0.2-0.4 (Low Risk)'
       WHEN score < 0.6 THEN '0.4-0.6 (Medium Risk)' WHEN score < 0.8 THEN '0.6-0.8 (High Risk)'
       ELSE '0.8-1.0 (Very High Risk)' END AS risk_bucket,
  CASE WHEN score IS NULL THEN NULL WHEN score <= 0.45 THEN 'low' WHEN score <= 0.6 THEN 'medium' ELSE 'high' END AS type_risk,
  CASE WHEN score < {DEFAULT_THRESHOLD} THEN 'accept' WHEN score IS NOT NULL THEN 'refuse' END AS decision,
  CASE WHEN score IS NULL THEN NULL WHEN score < 0.3 THEN 'low' WHEN score < 0.6 THEN 'medium' ELSE 'high' END AS decision_risk,
  CASE WHEN score IS NULL THEN NULL WHEN score < 0.45 THEN 'low' WHEN score < 0.6 THEN 'medium' ELSE 'high' END AS history_risk,
  CASE WHEN score >= 0.6 THEN 'refuse' WHEN score IS NOT NULL THEN 'accept' END AS history_decision,
  CASE WHEN score IS NULL THEN NULL WHEN score < 0.25 THEN 'very_good' WHEN score < 0.45 THEN 'good'
       WHEN score < 0.60 THEN 'moderate' WHEN score < 0.80 THEN 'high' ELSE 'very_high' END AS doc_band
FROM api_logs""")
def q_risk_bands(spark, d):
    s = F.col("score")
    return logs(spark, d).select(
        "log_id", B.risk_bucket(s).alias("risk_bucket"), B.type_risk(s).alias("type_risk"),
        B.decision(s, DEFAULT_THRESHOLD).alias("decision"), B.decision_risk(s).alias("decision_risk"),
        B.history_risk(s).alias("history_risk"), B.history_decision(s).alias("history_decision"),
        B.doc_band(s).alias("doc_band"))


@register("recent_logs", CTE + f"""SELECT log_id, "timestamp", client_id, prediction_type,
  {rnd('score')} AS score, {rnd('latency_seconds')} AS latency_seconds, error_message
FROM api_logs WHERE {_win(720)} ORDER BY "timestamp" DESC, log_id DESC LIMIT 100""")
def q_recent_logs(spark, d):
    r = H.recent_logs(logs(spark, d), AS_OF, last_n_hours=720, limit=100)
    return rounded(r.select("log_id", "timestamp", "client_id", "prediction_type", "score",
                            "latency_seconds", "error_message"))


HISTORY_FILTER = dict(min_score=0.2, max_score=0.8, types=("single", "batch"), client_search="1")


@register("history_page", CTE + f"""SELECT log_id, "timestamp", client_id, prediction_type,
  {rnd('score')} AS score
FROM api_logs
WHERE score >= 0.2 AND score <= 0.8 AND prediction_type IN ('single', 'batch')
  AND contains(lower(CAST(client_id AS VARCHAR)), '1')
ORDER BY "timestamp" DESC, log_id DESC LIMIT 25 OFFSET 50""")
def q_history_page(spark, d):
    f = H.filter_history(logs(spark, d), **HISTORY_FILTER)
    page = H.page(f, [F.col("timestamp").desc(), F.col("log_id").desc()], page=3, size=25)
    return rounded(page.select("log_id", "timestamp", "client_id", "prediction_type", "score"))


@register("resource_unpivot", CTE + f"""SELECT "timestamp", 'CPU (%)' AS resource_type, {rnd('cpu_usage_pct')} AS usage_pct
FROM api_logs WHERE cpu_usage_pct IS NOT NULL
UNION ALL
SELECT "timestamp", 'GPU (%)', {rnd('gpu_usage_pct')} FROM api_logs WHERE gpu_usage_pct IS NOT NULL""")
def q_resource_unpivot(spark, d):
    return rounded(H.resource_long(logs(spark, d)))


@register("payload_explode", CTE + """SELECT log_id, k AS feature, json_extract_string(input_data, k) AS value
FROM api_logs, unnest(json_keys(input_data)) AS t(k)""")
def q_payload_explode(spark, d):
    return H.payload_rows(logs(spark, d))


KEYSET_CURSOR = ("2024-01-20 00:00:00", 0)


@register("history_keyset_page", CTE + f"""SELECT log_id, "timestamp", client_id, {rnd('score')} AS score
FROM api_logs
WHERE score >= 0.2 AND score <= 0.8 AND prediction_type IN ('single', 'batch')
  AND contains(lower(CAST(client_id AS VARCHAR)), '1')
  AND ("timestamp" < TIMESTAMP '{KEYSET_CURSOR[0]}' OR ("timestamp" = TIMESTAMP '{KEYSET_CURSOR[0]}' AND log_id < {KEYSET_CURSOR[1]}))
ORDER BY "timestamp" DESC, log_id DESC LIMIT 25""")
def q_history_keyset_page(spark, d):
    """W5 deep paging: the page after a (timestamp, log_id) cursor."""
    f = H.filter_history(logs(spark, d), **HISTORY_FILTER)
    cursor = (F.lit(KEYSET_CURSOR[0]).cast("timestamp_ntz"), KEYSET_CURSOR[1])
    page = H.keyset_page(f, "timestamp", "log_id", cursor, 25)
    return rounded(page.select("log_id", "timestamp", "client_id", "score"))


@register("flatten_payload", """SELECT event_id AS log_id,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS "p.k",
  user_id AS "meta.client_id", event_type AS "meta.event_type"
FROM events""")
def q_flatten_payload(spark, d):
    """N1 + N3: the JSON payload parsed with an explicit schema and nested
    with the request metadata, then flattened to dotted columns."""
    from kredo.functions.payload import flatten
    e = table(spark, d, "events")
    nested = e.select(F.col("event_id").alias("log_id"),
                      F.from_json("props", "k int").alias("p"),
                      F.struct(F.col("user_id").alias("client_id"), "event_type").alias("meta"))
    return flatten(nested)


AS_OF_LOCAL = "2024-01-30 18:30:00"   # Europe/Paris wall clock


@register("frame_stats_local", f"""WITH {S.SQL_API_LOGS},
loc AS (SELECT * REPLACE (timezone('Europe/Paris', timezone('UTC', "timestamp")) AS "timestamp") FROM api_logs)
SELECT count(*) AS total,
  count(CASE WHEN error_message IS NULL THEN 1 END) AS successful,
  count(CASE WHEN error_message IS NOT NULL THEN 1 END) AS failed,
  {rnd('coalesce(avg(score), 0.0)')} AS avg_score, {rnd('coalesce(min(score), 0.0)')} AS min_score,
  {rnd('coalesce(max(score), 0.0)')} AS max_score,
  {rnd('avg(latency_seconds)')} AS avg_latency_seconds,
  {rnd('avg(cpu_usage_pct)')} AS avg_cpu_usage_pct, {rnd('avg(gpu_usage_pct)')} AS avg_gpu_usage_pct,
  {rnd('avg(gpu_memory_mb)')} AS avg_gpu_memory_mb,
  {rnd("100.0 * count(CASE WHEN error_message IS NOT NULL THEN 1 END) / nullif(count(*), 0)", 2)} AS error_rate_pct,
  count(CASE WHEN "timestamp" >= CAST(CAST(TIMESTAMP '{AS_OF_LOCAL}' AS DATE) AS TIMESTAMP) THEN 1 END) AS today_count
FROM loc WHERE {_win(24, f"TIMESTAMP '{AS_OF_LOCAL}'")}""")
def q_frame_stats_local(spark, d):
    """A9 + T1 + T3: log times taken as UTC, normalised to Europe/Paris, last
    24 hours before a local as-of, 'today' from local midnight."""
    return rounded(L.frame_stats(logs(spark, d), AS_OF_LOCAL, hours=24, source_zone="UTC"))
