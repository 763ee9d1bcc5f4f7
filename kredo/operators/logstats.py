"""Prediction-log statistics.

All summaries are a single aggregation pass (conditional aggregates instead
of one filter per slice); exact percentiles use the distributed rank from
``kredo.operators.ordered``.  Scalar subqueries (``DataFrame.scalar()``)
replace cross joins with one-row tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kredo.functions.bands import risk_bucket
from kredo.functions.numeric import round_half, to_number
from kredo.functions.timeutil import as_of_col, local_day_start, to_local_naive, within_last
from kredo.operators.ordered import percentile_columns



def _err():
    return F.col("error_message").isNotNull()


def _ok():
    return F.col("error_message").isNull()


def recent(logs: DataFrame, as_of: str | None, hours: int) -> DataFrame:
    """Rows of the last ``hours`` up to ``as_of`` (both bounds reach the
    Parquet scan as pushed filters).  Rows after ``as_of`` are excluded, so
    a replay at a past instant sees what was there then."""
    now = as_of_col(as_of)
    return logs.where(within_last(F.col("timestamp"), now, hours) & (F.col("timestamp") <= now))


def last_24h_stats(logs: DataFrame, as_of: str | None = None, hours: int = 24) -> DataFrame:
    """A7 (view ``last_24h_stats``)."""
    r = recent(logs, as_of, hours)
    total = F.count(F.lit(1))
    failed = F.count_if(_err())
    return r.agg(
        total.alias("total_predictions"),
        F.count_if(_ok()).alias("successful_predictions"),
        failed.alias("failed_predictions"),
        round_half(F.avg("latency_seconds"), 4).alias("avg_latency_seconds"),
        F.min("latency_seconds").alias("min_latency_seconds"),
        F.max("latency_seconds").alias("max_latency_seconds"),
        round_half(F.avg("score"), 4).alias("avg_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        round_half(F.try_divide(F.lit(100.0) * failed, total), 2).alias("error_rate_pct"),
    )


def prediction_stats(logs: DataFrame, as_of: str | None = None, last_n_hours: int = 24,
                     exact: bool = True) -> DataFrame:
    """N-hour summary with p95/p99 latency; missing values become 0.0."""
    r = recent(logs, as_of, last_n_hours)
    z = lambda e: F.coalesce(e, F.lit(0.0))
    total = F.count(F.lit(1))
    failed = F.count_if(_err())
    base = r.agg(
        total.alias("total"),
        F.count_if(_ok()).alias("successful"),
        failed.alias("failed"),
        z(F.avg("score")).alias("avg_score"),
        z(F.min("score")).alias("min_score"),
        z(F.max("score")).alias("max_score"),
        z(F.avg("latency_seconds")).alias("avg_latency_seconds"),
        z(F.min("latency_seconds")).alias("min_latency_seconds"),
        z(F.max("latency_seconds")).alias("max_latency_seconds"),
        z(F.avg("cpu_usage_pct")).alias("avg_cpu_usage_pct"),
        z(F.max("cpu_usage_pct")).alias("max_cpu_usage_pct"),
        z(F.avg("gpu_usage_pct")).alias("avg_gpu_usage_pct"),
        z(F.max("gpu_usage_pct")).alias("max_gpu_usage_pct"),
        z(F.avg("gpu_memory_mb")).alias("avg_gpu_memory_mb"),
        round_half(F.lit(100.0) * failed / F.greatest(total, F.lit(1)), 2).alias("error_rate_pct"),
    )
    pct = percentile_columns(r, "latency_seconds", {"p95": 0.95, "p99": 0.99}, exact=exact)
    p = pct.select(F.struct("p95", "p99")).scalar()   # one subquery for both
    return base.select("*", z(p["p95"]).alias("p95_latency_seconds"),
                       z(p["p99"]).alias("p99_latency_seconds"))


def frame_stats(logs: DataFrame, as_of: str | None = None, hours: int = 24,
                source_zone: str | None = None) -> DataFrame:
    """Summary of a log frame with numeric coercion and ``today_count``
    (rows since local midnight of ``as_of``).  With ``source_zone`` the log
    times are zone-aware wall clock of that zone and are first normalised to
    the local zone (T1); ``as_of`` is then local time."""
    if source_zone is not None:
        logs = logs.withColumn("timestamp", to_local_naive(F.col("timestamp"), source_zone=source_zone))
    r = recent(logs, as_of, hours)
    now = as_of_col(as_of)
    num = to_number  # N7
    total = F.count(F.lit(1))
    failed = F.count_if(_err())
    z = lambda e: F.coalesce(e, F.lit(0.0))
    return r.agg(
        total.alias("total"),
        F.count_if(_ok()).alias("successful"),
        failed.alias("failed"),
        z(F.avg("score")).alias("avg_score"),
        z(F.min("score")).alias("min_score"),
        z(F.max("score")).alias("max_score"),
        F.avg("latency_seconds").alias("avg_latency_seconds"),
        F.avg(num("cpu_usage_pct")).alias("avg_cpu_usage_pct"),
        F.avg(num("gpu_usage_pct")).alias("avg_gpu_usage_pct"),
        F.avg(num("gpu_memory_mb")).alias("avg_gpu_memory_mb"),
        round_half(F.try_divide(F.lit(100.0) * failed, total), 2).alias("error_rate_pct"),
        F.count_if(F.col("timestamp") >= local_day_start(now)).alias("today_count"),
    )


def stats_by_type(logs: DataFrame, as_of: str | None = None,
                  types: tuple[str, ...] = ("single", "batch")) -> DataFrame:
    """A10: per prediction type and combined, in ONE aggregation pass
    (conditional aggregates), then ``stack`` to one row per label.  A type
    with no rows gives total 0 and NULL averages."""
    now = as_of_col(as_of)
    last_hour = within_last(F.col("timestamp"), now, 1) & (F.col("timestamp") <= now)
    labels = list(types) + ["combined"]
    aggs = []
    for label in labels:
        p = F.lit(True) if label == "combined" else (F.col("prediction_type") == label)
        s = F.when(p, F.col("score"))
        lat = F.when(p, F.col("latency_seconds"))
        aggs += [
            F.count_if(p).alias(f"{label}__total"),
            F.avg(s).alias(f"{label}__avg_score"),
            F.min(s).alias(f"{label}__min_score"),
            F.max(s).alias(f"{label}__max_score"),
            F.stddev_samp(s).alias(f"{label}__std_score"),
            F.count_if(p & (F.col("score") > 0.6)).alias(f"{label}__high_risk"),
            F.count_if(p & (F.col("score") > 0.45) & (F.col("score") <= 0.6)).alias(f"{label}__medium_risk"),
            F.count_if(p & (F.col("score") <= 0.45)).alias(f"{label}__low_risk"),
            (F.avg(lat) * 1000).alias(f"{label}__avg_latency_ms"),
            (F.max(lat) * 1000).alias(f"{label}__max_latency_ms"),
            F.count_if(p & last_hour).alias(f"{label}__last_hour"),
        ]
    wide = logs.agg(*aggs)
    fields = ["total", "avg_score", "min_score", "max_score", "std_score", "high_risk",
              "medium_risk", "low_risk", "avg_latency_ms", "max_latency_ms", "last_hour"]
    stack_args = []
    for label in labels:
        stack_args.append(F.lit(label))
        stack_args += [F.col(f"{label}__{f}") for f in fields]
    return wide.select(F.stack(F.lit(len(labels)), *stack_args).alias("label", *fields))


def score_distribution(logs: DataFrame, as_of: str | None = None, days: int = 7,
                       denominator: str = "period") -> DataFrame:
    """A11 + J4: five risk buckets over the last ``days``; percentage of the
    period's rows (``denominator="period"``) or of the whole table ("all",
    the reference view's literal behaviour) via a scalar subquery."""
    r = recent(logs, as_of, days * 24)
    base = r if denominator == "period" else logs
    n = base.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (r.groupBy(risk_bucket("score").alias("risk_bucket"))
            .agg(F.count(F.lit(1)).alias("count"))
            .withColumn("percentage", round_half(F.try_divide(F.lit(100.0) * F.col("count"), n), 2))
            .orderBy("risk_bucket"))                                            # O8


def score_histogram(logs: DataFrame, bins: int = 50) -> DataFrame:
    """Fixed-width histogram of scores over [0, 1]; 1.0 joins the last bin."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return (logs.where(F.col("score").isNotNull())
            .groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.col("bin") / bins).alias("bin_start"),
                    ((F.col("bin") + 1) / bins).alias("bin_end"), "count"))


def box_stats(df: DataFrame, value_col: str, group_cols: list[str] | tuple = (),
              exact: bool = True) -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 IQR) and
    outlier count, per group."""
    g = list(group_cols)
    q = percentile_columns(df, value_col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, g, exact)
    v = F.col(value_col)
    # the distinct values with their counts meet the quartiles, never the rows
    values = df.where(v.isNotNull()).groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("_n"))
    if g:
        j = values.join(q, on=g, how="inner")
    else:
        qs = q.select(F.struct("q1", "median", "q3")).scalar()   # one subquery
        j = values.select("*", *[qs[c].alias(c) for c in ("q1", "median", "q3")])
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return j.groupBy(*g).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        (F.first("q3") - F.first("q1")).alias("iqr"),
        F.min(F.when(v >= lo, v)).alias("lower_whisker"),
        F.max(F.when(v <= hi, v)).alias("upper_whisker"),
        F.sum(F.when((v < lo) | (v > hi), F.col("_n")).otherwise(0)).alias("n_outliers"),
        F.sum("_n").alias("n"),
    )


def hourly_performance(logs: DataFrame, bucket: str = "1 hour", exact: bool = True) -> DataFrame:
    """A26 (table ``api_performance``): one row per time bucket."""
    tb = F.window("timestamp", bucket).start.alias("time_bucket")
    t = logs.select(tb, "latency_seconds", "score", "error_message")
    total = F.count(F.lit(1))
    errors = F.count_if(_err())
    base = t.groupBy("time_bucket").agg(
        total.alias("total_requests"),
        F.avg("latency_seconds").alias("avg_latency_seconds"),
        F.min("latency_seconds").alias("min_latency_seconds"),
        F.max("latency_seconds").alias("max_latency_seconds"),
        errors.alias("error_count"),
        (F.lit(100.0) * errors / total).alias("error_rate"),
        F.avg("score").alias("avg_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )
    pct = percentile_columns(t, "latency_seconds",
                             {"p95_latency_seconds": 0.95, "p99_latency_seconds": 0.99},
                             ["time_bucket"], exact)
    return base.join(pct, on="time_bucket", how="left")


def latency_anomalies(logs: DataFrame, as_of: str | None = None, hours: int = 24,
                      exact: bool = True) -> DataFrame:
    """D5 + J3: rows of the window whose latency is above the window's p95."""
    r = recent(logs, as_of, hours)
    p95 = percentile_columns(r, "latency_seconds", {"p95": 0.95}, exact=exact).select("p95").scalar()
    return (r.where(F.col("latency_seconds") > p95)
            .select("log_id", "timestamp", "client_id", "score", "latency_seconds",
                    p95.alias("p95_latency"),
                    round_half(F.lit(100.0) * F.col("latency_seconds") / p95, 2).alias("pct_of_p95"))
            .orderBy(F.col("latency_seconds").desc(), F.col("log_id")))      # O7


def type_split_counts(logs: DataFrame) -> DataFrame:
    """Rows, successes and failures per prediction type in one pass."""
    return logs.groupBy("prediction_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_ok()).alias("successful"),
        F.count_if(_err()).alias("failed"))


def batch_summary(logs: DataFrame) -> DataFrame:
    """Per batch request (client and day of the batch rows): items,
    failures, mean of the non-null scores (NULL when all failed) and total
    latency."""
    b = logs.where(F.col("prediction_type") == "batch")
    return b.groupBy(F.col("client_id"), F.to_date("timestamp").alias("batch_date")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_err()).alias("failed"),
        round_half(F.avg("score"), 4).alias("avg_score"),
        F.sum("latency_seconds").alias("total_latency_seconds"))
