"""The reference profile kept as mergeable states, one set for each file.

A file's numeric columns are kept as count, mean, sum of squared deviations, minimum
and maximum, its other columns as value counts.  Both add up, so the profile of the
whole reference comes from the states, and a refresh reads the new files alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kredo.operators.profile import category_counts, numeric_profile
from kredo.sources.versions import Store


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, stamp): the Parquet files of a folder with size and time of change, from
    the listing; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    stamp = F.concat_ws("-", F.col("length").cast("string"), F.unix_millis("modificationTime").cast("string"))
    return found.select("path", _key("path").alias("file"), stamp.alias("stamp"))


def _key(path: str):
    """A file's name as both the listing and a scan give it."""
    return F.regexp_replace(F.expr(f"try_url_decode(replace({path}, '+', '%2B'))"), "^([a-z0-9]+):/+", "$1:/")


class ReferenceProfile:
    """The profile of the files of a folder, in a versioned store.

    ``prepare`` maps the frame of some files to the columns to profile."""

    def __init__(self, store: Store, path: str, numeric: list[str], categorical: list[str],
                 prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.store, self.path, self.prepare = store, path, prepare
        self.numeric, self.categorical = list(numeric), list(categorical)

    def refresh(self) -> list[str]:
        """Take in the files that are new or have changed, and forget those that are
        gone; returns the files that were read (names only are held by the driver).
        Tables: ``files`` (file, stamp, refresh), ``numbers`` and ``counts`` (states by
        file), each by ``refresh``, the number of the refresh that read them."""
        spark, change = self.store.spark, self.store.change()
        turn = change.base["notes"].get("refresh", 0) + 1
        listing = listed_files(spark, self.path)
        have = change.base["tables"].get("files", {"parts": {}})["parts"]
        known = self.store.read("files", version=change.base["version"]) if have else None
        new = listing if known is None else listing.join(known, ["file", "stamp"], "left_anti")
        paths = sorted(r["path"] for r in new.select("path").collect())
        gone = 0 if known is None else known.join(listing, ["file", "stamp"], "left_anti").count()
        if gone:
            stays = known.join(listing, ["file", "stamp"], "left_semi")
            change.replace("files", stays, "refresh", sorted(have))
        if paths:
            rows = self.prepare(spark.read.parquet(*paths).withColumn("_file", _key("input_file_name()")))
            number = F.lit(turn).alias("refresh")
            change.append("files", new.select("file", "stamp", number), "refresh")
            if self.numeric:
                states = numeric_profile(rows, self.numeric, ["_file"])
                squares = F.coalesce(F.col("std") * F.col("std") * (F.col("count") - 1), F.lit(0.0))
                change.append("numbers", states.where("count > 0").select(
                    F.col("_file").alias("file"), "feature", F.col("count").alias("n"), "mean", squares.alias("squares"),
                    "min", "max", number), "refresh")
            if self.categorical:
                change.append("counts", category_counts(rows, self.categorical, ["_file"]).select(
                    F.col("_file").alias("file"), "feature", "value", "n", number), "refresh")
        if paths or gone:
            change.note("refresh", turn)
            change.publish()
        return paths

    def _states(self, table: str) -> DataFrame:
        """States of the files that are there now: a file's newest ones."""
        files = self.store.read("files").select("file", "refresh")
        return self.store.read(table).join(files, ["file", "refresh"], "left_semi")

    def numbers(self) -> DataFrame:
        """(feature, mean, std, min, max, count), as ``numeric_profile`` of all files."""
        s = self._states("numbers")
        total = s.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
        # deviations of the files' means from the common one are added to those within
        merged = s.join(total, "feature").groupBy("feature").agg(
            F.first("_mean").alias("mean"),
            F.sum(F.col("squares") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))).alias("_squares"),
            F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n").alias("count"))
        std = F.when(F.col("count") > 1, F.sqrt(F.col("_squares") / (F.col("count") - 1)))
        return merged.select("feature", "mean", std.alias("std"), "min", "max", "count")

    def categories(self) -> DataFrame:
        """(feature, top_value, top_count, total, n_values, top_share), as
        ``category_profile`` of all files."""
        counts = self._states("counts").groupBy("feature", "value").agg(F.sum("n").alias("n"))
        return counts.groupBy("feature").agg(
            F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("top_value"),
            F.max("n").alias("top_count"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_values"),
        ).withColumn("top_share", F.col("top_count") / F.col("total"))


class ReferenceFrame:
    """Reference rows kept for reuse, until their files change or they are released."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._frame, self._seen = spark, path, None, None

    def get(self) -> DataFrame:
        """The rows, persisted; read anew if a file came, went or changed."""
        from pyspark import StorageLevel
        seen = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path).agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
        if self._frame is None or seen != self._seen:
            self.release()
            self._frame, self._seen = self.spark.read.parquet(self.path).persist(StorageLevel.MEMORY_AND_DISK), seen
        return self._frame

    def release(self) -> None:
        if self._frame is not None:
            self._frame.unpersist()
        self._frame = self._seen = None

    def __enter__(self) -> "ReferenceFrame":
        return self

    def __exit__(self, *_) -> None:
        self.release()
