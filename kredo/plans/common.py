"""Registry of the queries and helpers shared by the Spark side and the SQL
oracle side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

# Doubles are compared at 8 decimals below SMALL and at 4 from there on, in both engines.
# Both go through DECIMAL(38, 9) first: that removes summation-order noise, and the final
# decimal rounding is exact (half away from zero) in both engines, so exact decimal ties
# such as a mean of x.xxxx5 resolve the same way.
DIGITS, SMALL_DIGITS, SMALL = 4, 8, 10
PRE_DIGITS = 9

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register a Spark query ``fn(spark, sf_dir) -> DataFrame`` under ``key``
    with its DuckDB twin ``sql`` (``None`` = rows-only check)."""
    def wrap(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return wrap


def rounded(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Round every floating column (sum order differs between engines)."""
    def one(name: str):
        x = F.col(name).cast(f"decimal(38,{PRE_DIGITS})")
        if digits is not None:
            return F.round(x, digits).cast("double")
        return F.when(F.abs(x) < SMALL, F.round(x, SMALL_DIGITS).cast("double")).otherwise(F.round(x, DIGITS).cast("double"))

    return df.select(*[one(f.name).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def rnd(expr: str, digits: int | None = None) -> str:
    """SQL twin of ``rounded`` for one expression."""
    x = f"CAST({expr} AS DECIMAL(38, {PRE_DIGITS}))"
    if digits is not None:
        return f"CAST(round({x}, {digits}) AS DOUBLE)"
    return (f"CASE WHEN abs({x}) < {SMALL} THEN CAST(round({x}, {SMALL_DIGITS}) AS DOUBLE) "
            f"ELSE CAST(round({x}, {DIGITS}) AS DOUBLE) END")
