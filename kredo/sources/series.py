"""Rows kept in order - sorted files with a small table of their bounds.

Rows are range-partitioned by the order columns and sorted within files, so each file
holds the next stretch of the series.  ``<path>/files`` has one row for each file: its
number of rows and the first and last key.  A stretch of time reads the files whose
bounds meet it; a page reads the files that hold its places, found from the counts.
A row's place in the series is its file's first place plus its place in the file, which
Parquet knows: nothing is sorted again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000


class Series:
    """An ordered table at ``path``, by ``keys`` (together unique; the first is a time)."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("timestamp", "log_id")):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), tuple(keys)

    def write(self, rows: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> None:
        """Write the first rows; rows without a time have no place and are refused."""
        self._add(rows, rows_per_file, "errorifexists")

    def append(self, rows: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> None:
        """Add rows that are all later than those there.  Readers see the new files when
        their bounds are written, after the files."""
        first, last = rows.agg(F.min(F.struct(*self.keys))).first()[0], self.files().agg(F.max("last")).first()[0]
        if first is not None and last is not None and tuple(first) <= tuple(last):
            raise ValueError(f"rows from {tuple(first)} on lie before the last one there, {tuple(last)}")
        self._add(rows, rows_per_file, "append")

    def _add(self, rows: DataFrame, rows_per_file: int, mode: str) -> None:
        n, untimed = rows.agg(F.count(F.lit(1)), F.count_if(F.col(self.keys[0]).isNull())).first()
        if untimed:
            raise ValueError(f"{untimed} rows without {self.keys[0]}")
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        (rows.repartitionByRange(max(1, -(-n // rows_per_file)), *self.keys).sortWithinPartitions(*self.keys)
         .write.option("maxRecordsPerFile", 0).parquet(folder))
        key = F.struct(*self.keys)
        written = self.spark.read.parquet(folder).select(*self.keys, F.col("_metadata.file_path").alias("file"))
        bounds = written.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
        bounds.coalesce(1).write.mode(mode).parquet(f"{self.path}/files")

    def files(self) -> DataFrame:
        """(file, rows, first, last, place): one row for each file; ``place`` is that of
        its first row.  The window sees files, not rows."""
        earlier = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
        return self.spark.read.parquet(f"{self.path}/files").withColumn("place", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))

    def _read(self, which: Column) -> DataFrame:
        """Rows of the files that fit, with ``place``.  File names come to the driver, as
        they do to plan any scan."""
        found = self.files().where(which).select("file", "place").collect()
        if not found:
            schema = self.spark.read.parquet(f"{self.path}/data/*").schema
            return self.spark.createDataFrame([], schema).withColumn("place", F.lit(0).cast("long"))
        rows = self.spark.read.parquet(*[r["file"] for r in found])
        first = F.broadcast(self.spark.createDataFrame([(r["file"], r["place"]) for r in found], "_file string, _place long"))
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return rows.join(first, "_file").withColumn("place", F.col("_place") + F.col("_row")).drop("_file", "_row", "_place")

    def between(self, start: Column, end: Column) -> DataFrame:
        """O2: the series in (start, end], each row with its place: ascending time is
        ascending place."""
        t = self.keys[0]
        rows = self._read((F.col("last")[t] > start) & (F.col("first")[t] <= end))
        return rows.where((F.col(t) > start) & (F.col(t) <= end))

    def page(self, offset: int, limit: int, newest_first: bool = False) -> DataFrame:
        """The rows at places offset to offset + limit - 1 (counted from the newest
        row if so asked), sorted; only the files that hold them are read."""
        total = self.files().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        low, high = (total - offset - limit, total - offset) if newest_first else (offset, offset + limit)
        low = max(low, 0)
        rows = self._read((F.col("place") < high) & (F.col("place") + F.col("rows") > low))
        rows = rows.where((F.col("place") >= low) & (F.col("place") < high))
        return rows.orderBy(F.col("place").desc() if newest_first else F.col("place"))
