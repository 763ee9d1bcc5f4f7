"""Queries over versioned tables: each builds the tables from the test tables in the
shared folder, changes them and reads the published version back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from kredo.functions import timeutil as T
from kredo.operators import alerts as AL
from kredo.operators import archive as AR
from kredo.operators import drift as D
from kredo.operators import once as ON
from kredo.operators.alert_store import AlertStore
from kredo.operators.bucketed import BucketedTables, file_bytes, n_buckets
from kredo.operators import hourly as H
from kredo.operators.reference import ReferenceProfile
from kredo.plans import drift as DR
from kredo.plans import features as FE
from kredo.plans import ops as O
from kredo.plans import standins as S
from kredo.plans.common import register, rnd, rounded
from kredo.sources.versions import Store
from kredo.sources.series import Series
from kredo.sources.tables import table
from kredo.streaming import late as LT
from kredo.streaming.monitor import work_dir

AS_OF = "2024-01-31 06:00:00"    # inside a day, so that a partition is split
EARLIER = "2024-01-24 06:00:00"
DAYS = 14


def new_store(spark, name: str) -> Store:
    return Store(spark, os.path.join(work_dir(spark, name), "store"))


@register("archive_apply", O.CTE + f"""SELECT log_id, "timestamp", 'live' AS place, NULL AS archive_reason, NULL::TIMESTAMP AS archived_at
FROM api_logs WHERE "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY
UNION ALL SELECT log_id, "timestamp", 'archive', 'periodic_archive',
  CASE WHEN "timestamp" < TIMESTAMP '{EARLIER}' - INTERVAL {DAYS} DAY THEN TIMESTAMP '{EARLIER}' ELSE TIMESTAMP '{AS_OF}' END
FROM api_logs WHERE "timestamp" < TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY""")
def q_archive_apply(spark, d):
    """The log archived a week before, again today, and once more, which adds
    nothing; both tables as the last version has them."""
    store = new_store(spark, "archive")
    change = store.change()
    change.append("api_logs", S.api_logs(spark, d).withColumn("log_date", F.to_date("timestamp")), "log_date")
    change.publish()
    for as_of in (EARLIER, AS_OF, AS_OF):
        AR.apply_archive(store, as_of, DAYS)
    live = store.read("api_logs").select("log_id", "timestamp", F.lit("live").alias("place"),
                                         F.lit(None).cast("string").alias("archive_reason"),
                                         F.lit(None).cast("timestamp_ntz").alias("archived_at"))
    return live.unionByName(store.read("api_logs_archive").select(
        "log_id", "timestamp", F.lit("archive").alias("place"), "archive_reason", "archived_at"))


@register("alert_cleanup_apply", O.CTE + f""", {O._STATE_SQL}
SELECT alert_id, alert_type, severity, acknowledged, created_at, updated_at FROM state
WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY""")
def q_alert_cleanup_apply(spark, d):
    """The events of old alerts deleted, the state read from what is published."""
    store = new_store(spark, "cleanup")
    change = store.change()
    change.append("alert_events", O._events(spark, d).withColumn("created_date", F.to_date("created_at")), "created_date")
    change.publish()
    AL.apply_cleanup(store, AS_OF, DAYS)
    return AL.alert_state(store.read("alert_events").drop("created_date")).select(
        "alert_id", "alert_type", "severity", "acknowledged", "created_at", "updated_at")


_METRICS = f"""count(*) AS total_requests,
  {rnd('avg(latency_seconds)')} AS avg_latency_seconds, {rnd('min(latency_seconds)')} AS min_latency_seconds,
  {rnd('max(latency_seconds)')} AS max_latency_seconds, {rnd('quantile_disc(latency_seconds, 0.95)')} AS p95_latency_seconds,
  {rnd('quantile_disc(latency_seconds, 0.99)')} AS p99_latency_seconds,
  count(CASE WHEN error_message IS NOT NULL THEN 1 END) AS error_count,
  {rnd('100.0 * count(CASE WHEN error_message IS NOT NULL THEN 1 END) / count(*)')} AS error_rate,
  {rnd('avg(score)')} AS avg_score, {rnd('min(score)')} AS min_score, {rnd('max(score)')} AS max_score"""

# Three periods, one file each; failed predictions are reported with the next period's
# file, most of them long after their hour has passed.
PERIODS = ["2024-01-11", "2024-01-21"]


def _arrivals(spark, d, path: str):
    """Write the events as four files in the order they arrive, and read the folder as a
    stream that takes one file at a time."""
    events = table(spark, d, "events")
    period = F.when(F.col("ts") < PERIODS[0], 0).when(F.col("ts") < PERIODS[1], 1).otherwise(2)
    arrival = period + F.when(F.col("event_type") == "error", 1).otherwise(0)
    for i in range(4):
        events.where(arrival == i).coalesce(1).write.mode("append").parquet(path)
    return S.api_logs_from(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path))


@register("stream_late_rows", O.CTE + f""", a AS (SELECT *, CASE WHEN "timestamp" < '{PERIODS[0]}' THEN 0
    WHEN "timestamp" < '{PERIODS[1]}' THEN 1 ELSE 2 END + CASE WHEN error_message IS NOT NULL THEN 1 ELSE 0 END AS arrival FROM api_logs),
m AS (SELECT arrival, max(max("timestamp")) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    - INTERVAL 10 MINUTE AS mark FROM a GROUP BY arrival)
SELECT date_trunc('hour', "timestamp") AS time_bucket, date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS bucket_end,
  count(CASE WHEN date_trunc('hour', "timestamp") + INTERVAL 1 HOUR <= mark THEN 1 END) AS n_late,
  count(DISTINCT arrival) AS n_batches, {_METRICS}
FROM a JOIN m USING (arrival) GROUP BY 1, 2""")
def q_stream_late_rows(spark, d):
    """Rows that arrive long after their hour are kept, and their hours are
    restated; the hours are those of the whole log."""
    base = work_dir(spark, "late")
    store = Store(spark, os.path.join(base, "store"))
    LT.run_restating_stream(_arrivals(spark, d, os.path.join(base, "in")), store, os.path.join(base, "ckpt"))
    return rounded(store.read("hours").drop("log_date"))


@register("late_rows_kept", O.CTE + f""", a AS (SELECT *, CASE WHEN "timestamp" < '{PERIODS[0]}' THEN 0
    WHEN "timestamp" < '{PERIODS[1]}' THEN 1 ELSE 2 END + CASE WHEN error_message IS NOT NULL THEN 1 ELSE 0 END AS arrival FROM api_logs),
m AS (SELECT arrival, max(max("timestamp")) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    - INTERVAL 10 MINUTE AS mark FROM a GROUP BY arrival)
SELECT log_id, "timestamp", client_id, error_message, CAST(arrival AS BIGINT) AS batch_id FROM a JOIN m USING (arrival)
WHERE date_trunc('hour', "timestamp") + INTERVAL 1 HOUR <= mark""")
def q_late_rows_kept(spark, d):
    """The table of late rows, each with the batch that brought it."""
    base = work_dir(spark, "late")
    store = Store(spark, os.path.join(base, "store"))
    LT.run_restating_stream(_arrivals(spark, d, os.path.join(base, "in")), store, os.path.join(base, "ckpt"))
    return store.read("late").select("log_id", "timestamp", "client_id", "error_message", "batch_id")


def _hourly_table(spark, d) -> Store:
    """Hourly states of the log in a versioned table, as two runs would leave them."""
    store = new_store(spark, "hourly")
    logs = S.api_logs(spark, d)
    for part in (logs.where(F.col("timestamp") < PERIODS[1]), logs.where(F.col("timestamp") >= PERIODS[1])):
        change = store.change()
        change.append("states", H.hour_states(part), "log_date")
        change.publish()
    return store


@register("rolling_percentiles", O.CTE + f""", w AS (SELECT date_trunc('hour', "timestamp") - INTERVAL (i) HOUR AS time_bucket, *
  FROM api_logs, range(24) t(i))
SELECT time_bucket, time_bucket + INTERVAL 24 HOUR AS bucket_end, {_METRICS} FROM w GROUP BY 1, 2""")
def q_rolling_percentiles(spark, d):
    """Every metric of the rolling day, p95 and p99 too, from hourly states."""
    return rounded(H.rolling_metrics(_hourly_table(spark, d).read("states")))


SPAN = ("2024-01-17 12:00:00", "2024-01-18 12:00:00")


@register("span_percentiles", O.CTE + f"""SELECT TIMESTAMP '{SPAN[0]}' AS time_bucket, {_METRICS}
FROM api_logs WHERE "timestamp" >= TIMESTAMP '{SPAN[0]}' AND "timestamp" < TIMESTAMP '{SPAN[1]}'""")
def q_span_percentiles(spark, d):
    """The summary of any span of hours; only its days' folders are read.  The span is
    short enough for its sketch to be exact up to sf0.1."""
    store = _hourly_table(spark, d)
    days = [p for p in store.partitions("states") if SPAN[0][:10] <= p <= SPAN[1][:10]]
    start, end = (F.lit(t).cast("timestamp_ntz") for t in SPAN)
    return rounded(H.span_stats(store.read("states", days), start, end))


def _reference(spark, d) -> ReferenceProfile:
    """The applications as a folder of Parquet files that grows: older ones, then newer
    ones, with a refresh after each."""
    base = work_dir(spark, "reference")
    rows, path = S.applications(spark, d), os.path.join(base, "applications")
    profile = ReferenceProfile(Store(spark, os.path.join(base, "store")), path, DR.NUM, DR.CAT,
                               lambda df: df.select("_file", *D._typed(df, DR.NUM + DR.CAT, None)))
    split = F.col("APPLICATION_DATE") < F.lit(DR.SPLIT).cast("date")
    for part in (split, ~split):
        rows.where(part).write.mode("append").parquet(path)
        profile.refresh()
    return profile


_REFERENCE = f"""WITH {S.SQL_APPLICATIONS}, {DR._num_profile_sql('applications', 'p')}"""


@register("reference_profile", f"""{_REFERENCE}
SELECT feature, {rnd('mean')} AS mean, {rnd('std')} AS std, {rnd('mn')} AS min, {rnd('mx')} AS max, cnt AS count FROM p""")
def q_reference_profile(spark, d):
    """The numeric profile of the reference from states by file; the second
    refresh reads the newer files alone."""
    return rounded(_reference(spark, d).numbers())


@register("reference_categories", f"""WITH {S.SQL_APPLICATIONS}, {DR._cat_profile_sql('applications', 'p')}
SELECT feature, top_value, CAST(top_count AS BIGINT) AS top_count, total, n_values, {rnd('top_share')} AS top_share FROM p""")
def q_reference_categories(spark, d):
    """The category profile of the reference from value counts by file."""
    return rounded(_reference(spark, d).categories())


def _series(spark, d) -> Series:
    """The log as an ordered table of some thousand rows a file, the last ten days
    appended."""
    series = Series(spark, os.path.join(work_dir(spark, "series"), "log"))
    logs = S.api_logs(spark, d).select("log_id", "timestamp", "score", "latency_seconds")
    series.write(logs.where(F.col("timestamp") < PERIODS[1]), rows_per_file=2000)
    series.append(logs.where(F.col("timestamp") >= PERIODS[1]), rows_per_file=2000)
    return series


_PLACED = O.CTE + """, p AS (SELECT log_id, "timestamp", score, latency_seconds,
  row_number() OVER (ORDER BY "timestamp", log_id) - 1 AS place FROM api_logs)"""


@register("trend_series", _PLACED + f"""
SELECT place, log_id, "timestamp", {rnd('score')} AS score, {rnd('latency_seconds')} AS latency_seconds FROM p
WHERE "timestamp" > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND "timestamp" <= TIMESTAMP '{AS_OF}'""")
def q_trend_series(spark, d):
    """O2: the last seven days in order of time, from the files that hold them."""
    end = T.as_of_col(AS_OF)
    rows = _series(spark, d).between(end - F.expr("INTERVAL 7 DAYS"), end)
    return rounded(rows.select("place", "log_id", "timestamp", "score", "latency_seconds"))


@register("page_by_offset", _PLACED + """
SELECT place, log_id, "timestamp" FROM p WHERE place >= (SELECT count(*) FROM p) - 5100 AND place < (SELECT count(*) FROM p) - 5000""")
def q_page_by_offset(spark, d):
    """Page 51 of 100 rows, newest first, from the file that holds it."""
    return _series(spark, d).page(5000, 100, newest_first=True).select("place", "log_id", "timestamp")


SOURCE_BYTES = 16 << 20   # of source files to a bucket; a task reads some ten times that, the tables being wider


@register("merge_all_bucketed", FE.MERGE_ALL_SQL)
def q_merge_all_bucketed(spark, d):
    """All side tables, bucketed by client, joined onto train and test
    without an exchange.  A task reads one bucket of every table, so the buckets grow in
    number with the files that the tables come from, not in size."""
    main = S.train_and_test(spark, d)
    sides = {"bureau": S.bureau(spark, d), "previous": S.previous_applications(spark, d), "pos_cash": S.pos_cash(spark, d),
             "credit_card": S.credit_card(spark, d), "installments": S.installments(spark, d)}
    buckets = max(8, n_buckets(file_bytes(*main, *sides.values()), SOURCE_BYTES))
    tables = BucketedTables(spark, os.path.join(work_dir(spark, "bucketed"), "tables"), buckets)
    tables.write_main(*main)
    sides["installments"] = S.installments(spark, d, buckets)
    for kind, rows in sides.items():
        tables.write(kind, rows)
    return rounded(tables.merge_all())


DELIVERIES = [0, 3, 9]   # hours after the request at which it is delivered (again)


@register("request_log_once", """SELECT event_id AS request_id, user_id AS client_id, ts AS delivered_at, CAST(ts AS DATE) AS log_date FROM events""")
def q_request_log_once(spark, d):
    """Each request is delivered three times, hours apart, over several
    files; the log has it once, as it first came."""
    base = work_dir(spark, "once")
    e = table(spark, d, "events")
    sent = e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client_id"), F.explode(F.array(*[
        F.col("ts") + F.make_dt_interval(hours=F.lit(h)) for h in DELIVERIES])).alias("delivered_at"))
    path = os.path.join(base, "in")
    ends = ["2024-01-09 20:00:00", "2024-01-17 02:00:00", "2024-01-24 05:00:00", "2100-01-01 00:00:00"]
    for start, end in zip(["2000-01-01 00:00:00", *ends], ends):
        t = F.col("delivered_at")
        sent.where((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(path)
    store = Store(spark, os.path.join(base, "store"))
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(path)
    ON.run_log_once(stream, store, os.path.join(base, "ckpt"))
    return store.read("requests")


@register("alert_state_incremental", O.CTE + f""", {O._STATE_SQL}
SELECT alert_id, alert_type, severity, acknowledged, created_at, updated_at FROM state""")
def q_alert_state_incremental(spark, d):
    """Three rounds of events, the snapshot merged after two of them; the state
    is that of all events."""
    alerts = AlertStore(new_store(spark, "alerts"))
    events = O._events(spark, d)
    rounds = [F.col("updated_at") < PERIODS[0], (F.col("updated_at") >= PERIODS[0]) & (F.col("updated_at") < PERIODS[1]),
              F.col("updated_at") >= PERIODS[1]]
    for i, when in enumerate(rounds):
        alerts.add(events.where(when))
        if i < 2:
            alerts.compact()
    return alerts.current().select("alert_id", "alert_type", "severity", "acknowledged", "created_at", "updated_at")
