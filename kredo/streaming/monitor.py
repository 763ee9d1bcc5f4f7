"""Structured Streaming jobs over the prediction log.

* R2/R3: event-time windows with a watermark in UPDATE mode: state of a
  window is dropped once the watermark passes it (bounded state).  Each
  micro-batch writes its updated window rows to its own ``batch_id=N``
  folder (overwrite: a replayed batch is idempotent); ``latest_windows``
  reads the newest version of each window - an upsert without a table
  format that supports MERGE.
* R4: ``dropDuplicatesWithinWatermark`` on the log id (redelivered rows).
* R1: stream scoring with a fitted PipelineModel, appended to Parquet.
* R5: ``foreachBatch`` drift check of every micro-batch's payloads against static
  reference profiles, with drift row and alert.
* R6: rows dropped as late are reported by the query progress
  (``numRowsDroppedByWatermark``).  Spark filters late rows with the
  watermark of the previous micro-batch, so a row is dropped once an
  earlier batch has moved the watermark past its window.

Checkpoints and outputs go under the shared ``spark.checkpoint.dir``.
Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): the naive log time is read as
UTC wall-clock and converted back for output.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kredo.session import checkpoint_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run under the shared checkpoint dir."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def _session_zone(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone")


def with_event_time(logs: DataFrame, col: str = "timestamp") -> DataFrame:
    """``event_time``: the naive log time read as UTC wall clock, whatever
    the session time zone (a plain cast would use the session zone, and
    windows in a zone with a half-hour offset would start at :30)."""
    zone = _session_zone(logs)
    shifted = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(col).cast("timestamp_ntz"))
    return logs.withColumn("event_time", shifted.cast("timestamp"))


def _to_utc_wall_clock(ts, zone: str):
    """Inverse of ``with_event_time``: an instant back to naive UTC wall clock."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz"))


def _write_batch(batch: DataFrame, out_path: str, batch_id: int) -> None:
    """Idempotent micro-batch output: each batch owns the folder
    ``batch_id=N`` and overwrites it, so a batch replayed after a failure
    replaces its own rows instead of appending duplicates.  Readers get
    ``batch_id`` back through partition discovery."""
    batch.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))


def window_metrics(logs: DataFrame, duration: str = "1 hour", slide: str | None = None,
                   watermark: str = "10 minutes") -> DataFrame:
    """R2 (tumbling) / R3 (sliding) aggregation of the log, stream or batch.

    p95 and p99 are values of the window whose rank is exact within 1/10,000 of its
    rows (exact for windows of fewer rows): the sketch bounds the state of a window,
    which an exact percentile would fill with all its values."""
    w = F.window("event_time", duration, slide) if slide else F.window("event_time", duration)
    zone = _session_zone(logs)
    t = with_event_time(logs).withWatermark("event_time", watermark)
    err = F.col("error_message").isNotNull()
    return t.groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.avg("latency_seconds").alias("avg_latency_seconds"),
        F.min("latency_seconds").alias("min_latency_seconds"),
        F.max("latency_seconds").alias("max_latency_seconds"),
        F.percentile_approx("latency_seconds", 0.95, 10_000).alias("p95_latency_seconds"),
        F.percentile_approx("latency_seconds", 0.99, 10_000).alias("p99_latency_seconds"),
        F.count_if(err).alias("error_count"),
        (F.lit(100.0) * F.count_if(err) / F.count(F.lit(1))).alias("error_rate"),
        F.avg("score").alias("avg_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    ).select(_to_utc_wall_clock(F.col("w.start"), zone).alias("time_bucket"),
             _to_utc_wall_clock(F.col("w.end"), zone).alias("bucket_end"), "*").drop("w")


def hourly_parts(logs: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """R3, first step: sums, counts, minima and maxima of each hour, which add up to
    those of any longer span."""
    zone = _session_zone(logs)
    t = with_event_time(logs).withWatermark("event_time", watermark)
    parts = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("error_message").isNotNull()).alias("n_errors")]
    for c in ("latency_seconds", "score"):
        parts += [F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"),
                  F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return (t.groupBy(F.window("event_time", "1 hour").alias("w")).agg(*parts)
            .select(_to_utc_wall_clock(F.col("w.start"), zone).alias("time_bucket"), "*").drop("w"))


def rolling(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """R3, second step: windows of ``hours`` that start at each full hour, from the
    rows of ``hourly_parts``.  Only hourly rows are copied into the windows that hold
    them, never log rows."""
    w = hourly.select(F.explode(F.expr(
        f"transform(sequence(0, {int(hours) - 1}), i -> time_bucket - make_interval(0, 0, 0, 0, i))")).alias("start"), "*")
    total = F.sum("n")
    mean = {c: F.sum(f"sum_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0)) for c in ("latency_seconds", "score")}
    return w.groupBy(F.col("start").alias("time_bucket")).agg(
        total.alias("total_requests"), mean["latency_seconds"].alias("avg_latency_seconds"),
        F.min("min_latency_seconds").alias("min_latency_seconds"),
        F.max("max_latency_seconds").alias("max_latency_seconds"),
        F.sum("n_errors").alias("error_count"),
        (F.lit(100.0) * F.sum("n_errors") / total).alias("error_rate"),
        mean["score"].alias("avg_score"), F.min("min_score").alias("min_score"), F.max("max_score").alias("max_score"),
    ).withColumn("bucket_end", F.col("time_bucket") + F.make_interval(hours=F.lit(int(hours))))


def run_window_stream(stream: DataFrame, out_path: str, ckpt: str, duration: str = "1 hour",
                      slide: str | None = None, watermark: str = "10 minutes") -> dict:
    """``window_metrics`` to the end of the available input (``availableNow``) in
    update mode; returns the last progress metrics."""
    return run_update_stream(window_metrics(stream, duration, slide, watermark), out_path, ckpt)


def run_update_stream(agg: DataFrame, out_path: str, ckpt: str) -> dict:
    """Run a windowed aggregation to the end of the available input in update mode;
    returns the last progress metrics."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, out_path, batch_id)

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    progress = q.recentProgress or []
    dropped = sum((s.get("numRowsDroppedByWatermark", 0) or 0)
                  for p in progress for s in p.get("stateOperators", []))
    return {"batches": len(progress), "rows_dropped_by_watermark": dropped}


def latest_windows(spark: SparkSession, out_path: str, key: str = "time_bucket") -> DataFrame:
    """Newest version of every window row (``max_by`` on the batch id)."""
    df = spark.read.parquet(out_path)
    cols = [c for c in df.columns if c not in (key, "batch_id")]
    return (df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("s"))
            .select(key, "s.*"))


def dedup_stream(stream: DataFrame, key: str = "log_id", watermark: str = "1 hour") -> DataFrame:
    """Drop redelivered rows (same key) within the watermark."""
    return with_event_time(stream).withWatermark("event_time", watermark) \
        .dropDuplicatesWithinWatermark([key]).drop("event_time")


def run_append(df: DataFrame, out_path: str, ckpt: str, fmt: str = "parquet") -> None:
    q = (df.writeStream.outputMode("append").format(fmt).option("path", out_path)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def run_drift_stream(stream: DataFrame, reference: tuple, out_path: str, ckpt: str,
                     fields: list[str] | None = None, numeric: set[str] | None = None,
                     threshold: float = 0.05, payload: str = "input_data", tasks: int | None = None) -> None:
    """The payloads of each micro-batch against the ``reference`` profiles
    (``drift.side_profiles`` of that side, one row per feature and best read from a
    table).  A batch writes its details, its drift row (S11) and, if there is drift, an
    alert (S12) below ``out_path`` in folders of its own; the detection time is the
    newest log time among the batch's payloads, so a replayed batch gives the same rows.
    With ``tasks`` the payloads are dealt to so many tasks before they are parsed, for
    logs that arrive as few large files."""
    from pyspark import StorageLevel

    from kredo.functions.payload import payload_frame
    from kredo.operators import drift as D
    from kredo.operators.alerts import drift_alert
    from kredo.sources.sinks import drift_row
    fields = list(D.MONITORED_INPUT_FIELDS if fields is None else fields)

    def sink(batch: DataFrame, batch_id: int) -> None:
        # the payloads are parsed once; profiles and details are small and kept
        batch = batch.select("timestamp", payload)
        frame = payload_frame(batch.repartition(tasks) if tasks else batch, payload, fields=fields, keep=["timestamp"])
        frame = D.typed_fields(frame, fields, numeric, keep=["timestamp"]).persist(StorageLevel.MEMORY_AND_DISK)
        kept = [frame]
        try:
            newest = frame.agg(F.max("timestamp")).first()[0]
            if newest is None:
                return
            recent = D.side_profiles(frame, "recent", fields, numeric)
            both = [None if mine is None else mine.unionByName(kept_) for mine, kept_ in zip(recent, reference)]
            details = D.differences(*both, fields).coalesce(1).persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(details)
            _write_batch(details, os.path.join(out_path, "details"), batch_id)
            verdict = D.drift_verdict(details, threshold)
            at = F.lit(newest).cast("timestamp_ntz")
            _write_batch(drift_row(verdict, details, at), os.path.join(out_path, "drift"), batch_id)
            _write_batch(drift_alert(verdict, at), os.path.join(out_path, "alerts"), batch_id)
        finally:
            for df in kept:
                df.unpersist()

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
