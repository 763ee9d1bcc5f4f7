"""Hourly states of the prediction log that add up to any longer span.

A state row holds counts, sums, minima, maxima and a KLL sketch of the latencies, so
that the metrics of a span come from its hours alone, percentiles included: the log
itself is read once.  A sketch keeps all values up to about ``SKETCH_K`` of them, and
beyond that some tens of kilobytes; the rank of what it returns is then off by less
than 0.1 % of the span's rows (see the tests).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 4096
MEASURES = ("latency_seconds", "score")


def _merged() -> list[Column]:
    """Aggregates over states, under the names of the states' columns."""
    parts = [F.sum("n").alias("n"), F.sum("n_errors").alias("n_errors")]
    for c in MEASURES:
        parts += [F.sum(f"sum_{c}").alias(f"sum_{c}"), F.sum(f"n_{c}").alias(f"n_{c}"),
                  F.min(f"min_{c}").alias(f"min_{c}"), F.max(f"max_{c}").alias(f"max_{c}")]
    return [*parts, F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch")]


def hour_states(logs: DataFrame, *more: Column) -> DataFrame:
    """One state row for each hour (``time_bucket``, ``log_date``) of the rows; ``more``
    are further aggregates.  Rows without a time have no hour and are left out."""
    parts = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("error_message").isNotNull()).alias("n_errors")]
    for c in MEASURES:
        parts += [F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz")
    return (logs.where(F.col("timestamp").isNotNull()).groupBy(hour.alias("time_bucket"))
            .agg(*parts, F.kll_sketch_agg_double("latency_seconds", F.lit(SKETCH_K)).alias("sketch"), *more)
            .withColumn("log_date", F.to_date("time_bucket")))


def merged(states: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """States with the same ``by`` columns as one."""
    return states.groupBy(*by).agg(*_merged(), *more)


def metrics(states: DataFrame, keep: list[str], hours: int = 1) -> DataFrame:
    """The metrics of ``api_performance`` (A26) from states.  p95 and p99 are values of
    the span: the smallest at or below which lie 95 or 99 % of them."""
    mean = {c: F.col(f"sum_{c}") / F.nullif(F.col(f"n_{c}"), F.lit(0)) for c in MEASURES}

    def quantile(p: float) -> Column:
        return F.when(F.col("n_latency_seconds") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))

    return states.select(
        *keep, (F.col("time_bucket") + F.make_interval(hours=F.lit(hours))).alias("bucket_end"), F.col("n").alias("total_requests"),
        mean["latency_seconds"].alias("avg_latency_seconds"), F.col("min_latency_seconds"), F.col("max_latency_seconds"),
        quantile(0.95).alias("p95_latency_seconds"), quantile(0.99).alias("p99_latency_seconds"),
        F.col("n_errors").alias("error_count"), (F.lit(100.0) * F.col("n_errors") / F.col("n")).alias("error_rate"),
        mean["score"].alias("avg_score"), F.col("min_score"), F.col("max_score"))


def rolling_metrics(states: DataFrame, hours: int = 24) -> DataFrame:
    """The metrics of every window of ``hours`` that starts at a full hour and holds a
    row.  Hourly states are copied into the windows, never log rows."""
    starts = F.expr(f"transform(sequence(0, {int(hours) - 1}), i -> time_bucket - make_interval(0, 0, 0, 0, i))")
    w = states.withColumn("start", F.explode(starts)).drop("time_bucket")
    return metrics(merged(w, ["start"]).withColumnRenamed("start", "time_bucket"), ["time_bucket"], hours)


def span_stats(states: DataFrame, start: Column, end: Column) -> DataFrame:
    """A8 over the hours in (start, end] as one row: p95 and p99 of any span from its
    hourly states."""
    span = states.where((F.col("time_bucket") >= start) & (F.col("time_bucket") < end))
    one = merged(span.withColumn("_all", F.lit(1)), ["_all"]).withColumn("time_bucket", start)
    return metrics(one, ["time_bucket"]).drop("bucket_end")
