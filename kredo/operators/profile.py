"""Column profiles.

Numeric profile: ONE aggregate over all columns (not a pass per column),
then ``stack`` to one row per feature.  Category profile: values are
unpivoted to (feature, value), counted with map-side combine, and the
dominant value per feature is an aggregate (``min_by`` on (-count, value):
most frequent, ties to the smallest value) - no window over a feature's
values, so a high-cardinality column never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kredo.functions.numeric import number_of


def numeric_profile(df: DataFrame, cols: list[str], group_cols: list[str] | tuple = ()) -> DataFrame:
    """(group..., feature, mean, std, min, max, count) with NaN/invalid ->
    NULL skipped; sample std (NULL for one value).  One aggregate (per group)
    over all columns, then ``stack`` to one row per feature."""
    if not cols:
        raise ValueError("no numeric column to profile")
    g = list(group_cols)
    aggs = []
    for c in cols:
        v = number_of(df, c)
        aggs += [F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__std"),
                 F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"),
                 F.count(v).alias(f"{c}__count")]
    wide = df.groupBy(*g).agg(*aggs)
    args = []
    for c in cols:
        args += [F.lit(c)] + [F.col(f"{c}__{s}") for s in ("mean", "std", "min", "max", "count")]
    return wide.select(*g, F.stack(F.lit(len(cols)), *args)
                       .alias("feature", "mean", "std", "min", "max", "count"))


def category_counts(df: DataFrame, cols: list[str], group_cols: list[str] | tuple = ()) -> DataFrame:
    """(group..., feature, value, n): value counts of every column as text,
    NULLs dropped."""
    g = list(group_cols)
    long = df.select(*g, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        g, cols, "feature", "value")
    return long.where(F.col("value").isNotNull()).groupBy(*g, "feature", "value").agg(
        F.count(F.lit(1)).alias("n"))


def category_profile(df: DataFrame, cols: list[str], group_cols: list[str] | tuple = ()) -> DataFrame:
    """(group..., feature, top_value, top_count, total, n_values, top_share)."""
    if not cols:
        raise ValueError("no categorical column to profile")
    g = list(group_cols)
    vc = category_counts(df, cols, g)
    return vc.groupBy(*g, "feature").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("top_value"),
        F.max("n").alias("top_count"),
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("n_values"),
    ).withColumn("top_share", F.col("top_count") / F.col("total"))


def category_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """W3 + W2: every (feature, value) with its share of the feature and its
    rank (count desc, value asc), numbered over all tasks (``numbered``)."""
    from kredo.operators.ordered import numbered
    placed = numbered(category_counts(df, cols), "feature", [F.col("n").desc(), F.col("value").asc()], "_place")
    totals = placed.groupBy("feature").agg(F.sum("n").alias("_total"))
    return placed.join(totals, "feature").select(
        "feature", "value", "n", (F.col("n") / F.col("_total")).alias("share"),
        (F.col("_place") + 1).cast("int").alias("rank"))
