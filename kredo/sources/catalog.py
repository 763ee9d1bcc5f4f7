"""Tables by declared schemas; rows that don't fit go to a quarantine.

Line formats are read as text, which Spark splits anywhere, and parsed by the declared
schema.  A line that doesn't parse - columns too few or too many, text in a number, no
JSON - is kept with its file, its line number and the reason, not dropped."""

from __future__ import annotations

import functools
import logging
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kredo.functions.numeric import nan_to_null
from kredo.sources.files import _exists, file_encodings
from kredo.sources.schemas import CATALOG

log = logging.getLogger(__name__)

CORRUPT = "_corrupt"
QUARANTINE = "table STRING, file STRING, line BIGINT, raw STRING, reason STRING"


@dataclass
class Catalog:
    """Tables by name (rows that fit), rows that don't (``QUARANTINE``), names of
    tables without a file, and declared columns that a file lacks."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    quarantine: DataFrame | None = None
    missing: list[str] = field(default_factory=list)
    absent_columns: dict[str, list[str]] = field(default_factory=dict)

    def counts(self, spark: SparkSession) -> DataFrame:
        """(table, status, n_rows, n_bad): one row for each declared table."""
        parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), F.lit("loaded").alias("status"), "n_rows")
                 for name, df in self.tables.items()]
        none = spark.createDataFrame([(m, "missing") for m in self.missing], "table string, status string")
        parts.append(none.select("*", F.lit(None).cast("long").alias("n_rows")))
        found = functools.reduce(DataFrame.unionByName, parts)
        bad = self.quarantine.groupBy("table").agg(F.count(F.lit(1)).alias("n_bad"))
        return found.join(bad, "table", "left").withColumn(
            "n_bad", F.when(F.col("status") == "loaded", F.coalesce("n_bad", F.lit(0))))


def _lines(spark: SparkSession, path: str, encodings: dict[str, list[str]] | None = None) -> DataFrame:
    """(value, file, block, at): lines with their file, the offset of their split and a
    number that counts up within a split.  Files of another encoding than UTF-8 are
    decoded from their bytes."""
    parts = []
    for encoding, files in (encodings or {"UTF-8": [path]}).items():
        lines = spark.read.text(files).select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"))
        if encoding.upper() != "UTF-8":
            lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
        parts.append(lines)
    return functools.reduce(DataFrame.unionByName, parts)


def _numbered(bad: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``line`` (from 1): the place in the split and the lines of earlier splits of
    the file, from one count for each split."""
    runs = lines.join(bad.select("file").distinct(), "file", "left_semi").groupBy("file", "block").agg(
        F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return bad.join(runs, ["file", "block"]).withColumn("line", F.col("at") - F.col("_first") + F.col("_before") + 1)


def _as_text(schema: StructType) -> StructType:
    return StructType([StructField(f.name, StringType()) for f in schema.fields])


def _parted(lines: DataFrame, body: Column, parse, schema: StructType, malformed: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines with number and reason) of the text lines that ``body`` picks, by
    ``parse(text, schema)``."""
    with_corrupt = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = lines.where(body).withColumn("_row", parse(F.col("value"), with_corrupt))
    fits = F.col(f"_row.{CORRUPT}").isNull() & F.col("_row").isNotNull()
    good = parsed.where(fits).select("_row.*").drop(CORRUPT)
    bad = parsed.where(~fits)
    # a line that is sound as text fails by the type of some columns; name them
    text = StructType([*_as_text(schema).fields, StructField(CORRUPT, StringType())])
    bad = bad.withColumn("_text", parse(F.col("value"), text))
    wrong = F.array_compact(F.array(*[
        F.when(F.col("_text")[f.name].isNotNull() & F.col("_row")[f.name].isNull(), f.name) for f in schema.fields]))
    reason = F.when(F.col(f"_text.{CORRUPT}").isNotNull() | F.col("_text").isNull() | (F.size(wrong) == 0), malformed).otherwise(
        F.concat(F.lit("type: "), F.array_join(wrong, ",")))
    return nan_to_null(good), _numbered(bad.withColumn("reason", reason), lines).select(
        "file", "line", F.col("value").alias("raw"), "reason")


def _matched(good: DataFrame, declared: StructType) -> tuple[DataFrame, list[str]]:
    """The declared columns first, absent ones as NULL, then what else there is."""
    absent = [f.name for f in declared.fields if f.name not in good.columns]
    for f in declared.fields:
        if f.name in absent:
            good = good.withColumn(f.name, F.lit(None).cast(f.dataType))
    return good.select(*declared.names, *[c for c in good.columns if c not in declared.names]), absent


def read_csv_checked(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, bad lines, absent columns) of CSV files with a header and one record a
    line.  The header names the columns; the declared types hold for those declared.
    Each file's encoding is judged for itself, and files are split among tasks."""
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    encodings = file_encodings(spark, path)
    if not encodings:
        return spark.createDataFrame([], declared), spark.createDataFrame([], "file string, line long, raw string, reason string"), []
    encoding, files = next(iter(encodings.items()))
    names = spark.read.option("header", True).option("encoding", encoding).csv(files[0]).columns
    types = {f.name: f.dataType for f in declared.fields}
    schema = StructType([StructField(n, types.get(n, StringType())) for n in names])
    lines = _lines(spark, path, encodings)
    plain = F.regexp_replace(F.ltrim(F.regexp_replace("value", "﻿", "")), '"', "")
    body = (plain != ",".join(names)) & (F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"'}
    parse = lambda text, s: F.from_csv(text, _ddl(s), options)
    good, bad = _parted(lines, body, parse, schema, "columns")
    good, absent = _matched(good, declared)
    return good, bad, absent


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def read_ndjson_checked(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame, list[str]]:
    """S3: (rows, bad lines, absent columns) of JSON lines; blank lines are none."""
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = _lines(spark, path)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parse = lambda text, s: F.from_json(text, s, options)
    good, bad = _parted(lines, F.trim("value") != "", parse, declared, "not JSON")
    return good, bad, []


def read_parquet_checked(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, bad rows, absent columns) of Parquet files: declared columns take their
    declared type, and a row with a value that doesn't fit it goes to the quarantine, as
    JSON and without a line."""
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.parquet(path)
    casts = {f.name: F.col(f.name).try_cast(f.dataType) for f in declared.fields
             if f.name in raw.columns and raw.schema[f.name].dataType != f.dataType}
    wrong = F.array_compact(F.array(F.lit(None).cast("string"), *[
        F.when(F.col(c).isNotNull() & e.isNull(), c) for c, e in casts.items()]))
    good, absent = _matched(nan_to_null(raw.where(F.size(wrong) == 0).withColumns(casts)), declared)
    bad = raw.where(F.size(wrong) > 0).select(
        F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("line"),
        F.to_json(F.struct(*raw.columns)).alias("raw"), F.concat(F.lit("type: "), F.array_join(wrong, ",")).alias("reason"))
    return good, bad, absent


def load_catalog(spark: SparkSession, data_path: str, schemas: dict[str, tuple[str, str]] = CATALOG) -> Catalog:
    """Every declared table that has files under ``data_path``: a Parquet folder of
    its name, else its file (CSV, or JSON lines for ``.log`` and ``.json``).  A table
    without files is a warning.  Tables and quarantine are lazy."""
    found, quarantine = Catalog(), []
    for name, (file, schema) in schemas.items():
        parquet, path = os.path.join(data_path, name + ".parquet"), os.path.join(data_path, file)
        if _exists(spark, parquet):
            good, bad, absent = read_parquet_checked(spark, parquet, schema)
        elif not _exists(spark, path):
            log.warning("no file of table %s under %s", name, data_path)
            found.missing.append(name)
            continue
        elif file.endswith((".log", ".json")):
            good, bad, absent = read_ndjson_checked(spark, path, schema)
        else:
            good, bad, absent = read_csv_checked(spark, path, schema)
        found.tables[name] = good
        found.absent_columns[name] = absent
        quarantine.append(bad.select(F.lit(name).alias("table"), "file", "line", "raw", "reason"))
    empty = spark.createDataFrame([], QUARANTINE)
    found.quarantine = functools.reduce(DataFrame.unionByName, quarantine, empty)
    return found
