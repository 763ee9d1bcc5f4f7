"""File sources."""

from __future__ import annotations

import functools
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from kredo.functions.numeric import nan_to_null

log = logging.getLogger(__name__)

# The CSV files of the credit catalog and the encoding order.
CATALOG_FILES = [
    "application_train.csv", "application_test.csv", "bureau.csv", "bureau_balance.csv",
    "previous_application.csv", "POS_CASH_balance.csv", "credit_card_balance.csv",
    "installments_payments.csv", "HomeCredit_columns_description.csv",
]
ENCODINGS = ("UTF-8", "ISO-8859-1", "windows-1252")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def file_encodings(spark: SparkSession, path: str, encodings=ENCODINGS) -> dict[str, list[str]]:
    """S1 for a folder or pattern: the files of each encoding, every file judged for
    itself.  The driver holds file names alone, as it does to plan the scan."""
    lines = spark.read.text(path)
    left = set(lines.inputFiles())
    found: dict[str, list[str]] = {}
    for enc in encodings:
        if enc.upper().replace("_", "-") in ("UTF-8", "UTF8"):
            bad = {r[0] for r in lines.where(~F.is_valid_utf8("value")).select(F.input_file_name()).distinct().collect()}
        else:
            bad = set()                     # decodes any byte
        if left - bad:
            found[enc] = sorted(left - bad)
        left &= bad
    if left:
        raise UnicodeError(f"cannot decode {sorted(left)} with {encodings}")
    return found


def _one_schema(schemas: list[StructType]) -> StructType:
    """Column by column: the same type, else double for numbers, else text."""
    def merged(fields):
        kinds = {f.dataType for f in fields}
        if len(kinds) == 1:
            return fields[0]
        number = all(isinstance(k, NumericType) for k in kinds)
        return StructField(fields[0].name, DoubleType() if number else StringType())
    if len({len(s.fields) for s in schemas}) > 1:
        raise ValueError("the files have different numbers of columns")
    return StructType([merged(fields) for fields in zip(*[s.fields for s in schemas])])


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             encodings=ENCODINGS, multi_line: bool = False,
             encoding: str | None = None) -> DataFrame:
    """CSV with header and encoding fallback, decided for each file.  Proving a
    file is valid UTF-8 takes a full pass, so at scale give ``encoding`` (no
    detection) and a schema (no inference pass)."""
    def read(enc: str, paths, schema):
        r = (spark.read.option("header", True).option("encoding", enc)
             .option("multiLine", multi_line).option("escape", '"'))
        return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(paths)

    if encoding:
        return nan_to_null(read(encoding, path, schema))
    groups = file_encodings(spark, path, encodings)
    if len(groups) <= 1:
        return nan_to_null(read(next(iter(groups), encodings[0]), path, schema))
    if schema is None:
        schema = _one_schema([read(enc, files, None).schema for enc, files in groups.items()])
    parts = [read(enc, files, schema) for enc, files in groups.items()]
    return nan_to_null(functools.reduce(DataFrame.union, parts))


def load_catalog(spark: SparkSession, data_path: str, files=CATALOG_FILES,
                 schemas: dict | None = None) -> dict[str, DataFrame]:
    """Lazy DataFrames keyed by file name without extension; a missing
    file is a warning (Parquet folders of the same name are preferred)."""
    out = {}
    for name in files:
        stem = name.rsplit(".", 1)[0]
        pq = os.path.join(data_path, stem + ".parquet")
        csv = os.path.join(data_path, name)
        if _exists(spark, pq):
            out[stem] = nan_to_null(spark.read.parquet(pq))
        elif _exists(spark, csv):
            out[stem] = read_csv(spark, csv, (schemas or {}).get(stem))
        else:
            log.warning("catalog file %s not found under %s", name, data_path)
    return out


LOG_JSON_SCHEMA = ("timestamp string, client_id long, prediction_type string, input_data string, "
                   "score double, latency_seconds double, cpu_usage_pct double, "
                   "gpu_usage_pct double, gpu_memory_mb double, compute_device string, "
                   "error_message string, model_version string, log_id long")


def read_ndjson_logs(spark: SparkSession, path: str, schema: str = LOG_JSON_SCHEMA) -> DataFrame:
    """S3: NDJSON log; blank and malformed lines dropped, timestamp parsed;
    a missing path gives an empty frame with the schema."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema).withColumn(
            "timestamp", F.col("timestamp").cast("timestamp_ntz"))
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return nan_to_null(df.withColumn("timestamp",
                                     F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz")))


RESOURCE_COLUMNS = {"cpu_usage_pct": "double", "gpu_usage_pct": "double",
                    "gpu_memory_mb": "double", "compute_device": "string"}


def read_log_table(spark: SparkSession, path: str, as_of: str, last_n_hours: int = 24,
                   limit: int | None = None, merge_schema: bool = False) -> DataFrame:
    """Prediction-log table partitioned by ``log_date``.  The date
    bound prunes partitions, the time bound is pushed to the Parquet scan;
    with a limit the newest rows, newest first (a top-k, no full sort); resource
    columns absent from older data are added as NULL."""
    now = F.lit(as_of).cast("timestamp_ntz")
    start = now - F.expr(f"INTERVAL {int(last_n_hours)} HOURS")
    df = spark.read.option("mergeSchema", merge_schema).parquet(path)
    df = df.where((F.col("log_date") >= F.to_date(start)) & (F.col("log_date") <= F.to_date(now))
                  & (F.col("timestamp") > start) & (F.col("timestamp") <= now))
    for c, t in RESOURCE_COLUMNS.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df.orderBy(F.col("timestamp").desc(), F.col("log_id").desc()).limit(limit) if limit else df


def reference_frame(spark: SparkSession, path: str) -> DataFrame:
    """The reference data, kept for reuse (memory, spilling to disk)."""
    from pyspark import StorageLevel
    return spark.read.parquet(path).persist(StorageLevel.MEMORY_AND_DISK)


def read_json_array(spark: SparkSession, path: str, nested: str = "data") -> DataFrame:
    """file(s) holding a JSON array of ``{description, data{...}}``."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(*[c for c in df.columns if c != nested], f"{nested}.*")


def read_threshold(spark: SparkSession, path: str, key: str = "optimal_threshold",
                   default: float = 0.5) -> float:
    """The decision threshold artifact (one small JSON object)."""
    try:
        row = spark.read.json(path).select(key).first()
    except AnalysisException:
        return default
    return float(row[0]) if row is not None and row[0] is not None else default
