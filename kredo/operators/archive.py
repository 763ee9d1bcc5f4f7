"""Idempotent archive of old prediction logs on plain Parquet.

One fixed cutoff for the whole run.  Old rows not yet in the archive
(``left_anti`` on ``log_id``: re-running adds nothing) are appended to the
archive first; only then is the remaining live set written - to a NEW
version folder, never over the folder being read.  A crash between the two
writes leaves every row in the live set, so nothing is lost and the next run
is a no-op for rows already archived.

``apply_archive`` does the same to a store of versioned tables: only the days before
the cutoff are read, and both tables change in one published version.
"""

from __future__ import annotations


from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kredo.sources.versions import Store


def archive_plan(live: DataFrame, archive: DataFrame | None, cutoff: Column,
                 reason: str = "periodic_archive",
                 archived_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append to the archive, rows that stay live).  ``days = 0``
    gives a cutoff of ``as_of``: everything older moves."""
    old = live.where(F.col("timestamp") < cutoff)
    new = old if archive is None else old.join(archive.select("log_id"), "log_id", "left_anti")
    stamp = archived_at if archived_at is not None else cutoff
    to_archive = new.select("*", F.lit(reason).alias("archive_reason"),
                            stamp.alias("archived_at"))
    return to_archive, live.where(~(F.col("timestamp") < cutoff) | F.col("timestamp").isNull())


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def archive_logs(spark: SparkSession, live_path: str, archive_path: str, out_live_path: str,
                 as_of: str, days: int = 30) -> dict:
    """Run the move; returns {archived: rows added to the archive by this run,
    remaining: live rows}.  ``out_live_path`` must differ from ``live_path``
    (the caller swaps the pointer after success).  Only this run's rows are
    counted - the archive, which only grows, is never rescanned."""
    from pyspark import StorageLevel
    if out_live_path.rstrip("/") == live_path.rstrip("/"):
        raise ValueError("write the remaining live rows to a new path")
    live = spark.read.parquet(live_path)
    # only an archive that is not there is an empty one: a read error must not let
    # rows be archived twice
    archive = spark.read.parquet(archive_path) if _exists(spark, archive_path) else None
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    to_archive, remaining = archive_plan(live, archive, cutoff)
    # computed once: written and counted from the persisted rows
    to_archive = to_archive.withColumn("archive_date", F.to_date("timestamp")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        archived = to_archive.count()
        if archived:
            to_archive.hint("rebalance", "archive_date") \
                .write.mode("append").partitionBy("archive_date").parquet(archive_path)
    finally:
        to_archive.unpersist()
    remaining.write.mode("errorifexists").parquet(out_live_path)
    return {"archived": archived, "remaining": spark.read.parquet(out_live_path).count()}


def days_before(store: Store, table: str, cutoff: datetime) -> tuple[list[str], list[str]]:
    """Partitions by day: (those wholly before the cutoff, that of the cutoff's own day
    if it begins before the cutoff)."""
    day = cutoff.date().isoformat()
    known = [p for p in store.partitions(table) if p[:1].isdigit()]
    return [p for p in known if p < day], [p for p in known if p == day and cutoff.time() != datetime.min.time()]


def apply_archive(store: Store, as_of: str, days: int = 30, live: str = "api_logs", archive: str = "api_logs_archive",
                  reason: str = "periodic_archive") -> dict:
    """Move the log rows older than ``days`` at ``as_of`` from table ``live`` to
    table ``archive`` (both by ``log_date``) and publish both as one version.

    Days before the cutoff are read and leave the live table; the cutoff's own day is
    written anew with what stays; later days are not touched.  Rows whose ``log_id``
    is in the archive's same days already are not added again, so a second run adds
    nothing and publishes nothing.  Returns {archived, remaining, version}."""
    cutoff = datetime.fromisoformat(as_of) - timedelta(days=days)
    change = store.change()        # a version published from here on makes this one fail
    whole, partly = days_before(store, live, cutoff)
    archived = 0
    if whole or partly:
        at = F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")
        rows = store.read(live, whole + partly)
        known = store.read(archive, whole + partly) if archive in store.manifest()["tables"] else None
        new, _ = archive_plan(rows, known, at, reason, F.lit(as_of).cast("timestamp_ntz"))
        stays = store.read(live, partly).where(F.col("timestamp") >= at) if partly else None
        if known is not None:
            new = new.select(*known.columns)
        archived = sum(change.append(archive, new, "log_date").values())
        before = sum(n for p in partly for n in change.base["tables"][live]["parts"][p].values())
        change.drop(live, whole)
        left = sum(change.replace(live, stays, "log_date", partly).values()) if partly else before
        if whole or left != before:
            change.publish()
    now = store.manifest()
    parts = now["tables"].get(live, {"parts": {}})["parts"]
    return {"archived": archived, "remaining": sum(n for w in parts.values() for n in w.values()), "version": now["version"]}
