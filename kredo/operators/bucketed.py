"""J1, J2, U4 on tables bucketed by client: aggregates and joins without an exchange.

Each side table is written once with ``bucketBy(n, client)``; all have the same number
of buckets, so bucket i of every table holds the same clients.  The aggregates A1-A5
and the five left joins then work bucket by bucket.  A client with very many rows stays
in one bucket, where its rows are aggregated as they are read; the rows of a bucket are
never held at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kredo.operators.aggregates import KEY
from kredo.operators.joins import SIDE_TABLES, join_aggregates

MAIN = "application"


def n_buckets(total_bytes: int, bucket_bytes: int = 128 << 20) -> int:
    """Buckets for side tables of ``total_bytes`` together."""
    return max(1, -(-total_bytes // bucket_bytes))


def file_bytes(*tables: DataFrame) -> int:
    """Size of the files that the tables are read from, counted for each table."""
    spark, total = tables[0].sparkSession, 0
    conf = spark._jsc.hadoopConfiguration()
    for df in tables:
        for name in df.inputFiles():
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
            total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


class BucketedTables:
    """Tables of one set, bucketed alike, under ``path`` and in the session's catalog."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, key: str = KEY, prefix: str | None = None):
        self.spark, self.path, self.buckets, self.key = spark, path.rstrip("/"), buckets, key
        self.prefix = prefix or f"bucketed_{uuid.uuid4().hex[:12]}"

    def name(self, kind: str) -> str:
        return f"{self.prefix}_{kind}"

    def write(self, kind: str, rows: DataFrame) -> None:
        """Write a table: one exchange now, one file a bucket."""
        (rows.repartition(self.buckets, self.key).write.mode("overwrite").option("path", f"{self.path}/{kind}")
         .bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.name(kind)))

    def write_main(self, train: DataFrame, test: DataFrame) -> None:
        """U4: train and test as one table, told apart by ``split``."""
        both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)
        self.write(MAIN, both)

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(self.name(kind))

    def merge_all(self) -> DataFrame:
        """The aggregates of every side table that was written, joined onto train and
        test in one plan that moves no row between tasks."""
        sides = {k: self.table(k) for k in SIDE_TABLES if self.spark.catalog.tableExists(self.name(k))}
        return join_aggregates(self.table(MAIN), sides, self.key)

    def drop(self) -> None:
        """Take the tables out of the catalog; the files stay."""
        for kind in (MAIN, *SIDE_TABLES):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(kind)}")
