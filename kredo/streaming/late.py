"""R6 + A26: hourly performance of a stream in which no late row is lost.

The windowed aggregation of ``monitor`` drops rows behind its watermark.  Here each
micro-batch becomes hourly states (``operators.hourly``), which add up: an hour that a
late row belongs to is merged again from its states and published over the old row.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kredo.operators import hourly as H
from kredo.sources.versions import Store


def restate(store: Store, batch: DataFrame, batch_id: int, delay: timedelta = timedelta(minutes=10)) -> dict:
    """Publish one micro-batch of log rows as the next version of a store.

    Tables, all by ``log_date``: ``late`` keeps the rows whose hour had ended before the
    watermark (the newest time of earlier batches less ``delay``), with the batch that
    brought them; ``states`` keeps the hourly states of each batch; ``hours`` has the
    metrics of each hour, with the number of its late rows and of the batches that
    brought it.  Only hours with a row in the batch are merged and written anew, and
    only days that hold such an hour get a new folder.

    The version notes the batch, the watermark and how many rows had no time (they
    have no hour and are counted as dropped).  A batch that is replayed after it was
    published changes nothing; one that failed before left nothing to see."""
    from pyspark import StorageLevel
    change = store.change()
    notes = change.base["notes"]
    if notes.get("batch", -1) >= batch_id:
        return notes
    mark = notes.get("watermark")
    hour_end = F.date_trunc("hour", "timestamp").cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")
    late = hour_end <= F.lit(mark).cast("timestamp_ntz") if mark else F.lit(False)
    rows = batch.withColumn("_late", F.coalesce(late, F.lit(False))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        seen = rows.agg(F.max("timestamp").alias("newest"), F.count_if(F.col("timestamp").isNull()).alias("untimed"),
                        F.count_if("_late").alias("late")).first()
        if seen["newest"] is not None:
            if seen["late"]:
                change.append("late", rows.where("_late").drop("_late").withColumn("batch_id", F.lit(batch_id).cast("long"))
                              .withColumn("log_date", F.to_date("timestamp")), "log_date")
            new = H.hour_states(rows, F.count_if("_late").alias("n_late")).withColumn("batch_id", F.lit(batch_id).cast("long"))
            days = sorted(change.append("states", new, "log_date"))
            states = change.read("states", days)
            touched = states.where(F.col("batch_id") == batch_id).select("time_bucket")
            mine = H.merged(states.join(touched, "time_bucket", "left_semi"), ["time_bucket"],
                            F.sum("n_late").alias("n_late"), F.count(F.lit(1)).alias("n_batches"))
            hours = H.metrics(mine, ["time_bucket", "n_late", "n_batches"]).withColumn("log_date", F.to_date("time_bucket"))
            if "hours" in change.base["tables"]:
                others = store.read("hours", days, change.base["version"]).join(touched, "time_bucket", "left_anti")
                hours = hours.unionByName(others)
            change.replace("hours", hours, "log_date", days)
            newest = (seen["newest"] - delay).isoformat(sep=" ")
            change.note("watermark", max(newest, mark) if mark else newest)
        change.note("batch", batch_id)
        change.note("dropped", notes.get("dropped", 0) + seen["untimed"])
        change.publish()
        return change.base["notes"]
    finally:
        rows.unpersist()


def run_restating_stream(stream: DataFrame, store: Store, ckpt: str, delay: timedelta = timedelta(minutes=10)) -> dict:
    """``restate`` for each micro-batch to the end of the available input; returns the
    notes of the last version."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        restate(store, batch, batch_id, delay)

    q = (stream.writeStream.foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return store.manifest()["notes"]
