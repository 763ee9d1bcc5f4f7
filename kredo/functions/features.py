"""Ratio, age, external-score and document features.

Pure column expressions (one projection, inside whole-stage codegen).  Each
feature is added only when its inputs exist.  Division never fails or yields
infinity: ``try_divide`` turns a zero denominator into NULL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25
EXT_SOURCE_RE = re.compile(r"^EXT_SOURCE_\d+$")
DOCUMENT_RE = re.compile(r"^FLAG_DOCUMENT_\d+$")


def _ratio(num: str, den: str) -> Column:
    return F.try_divide(F.col(num), F.col(den) + F.lit(1))


def ratio_feature_exprs(columns: list[str]) -> dict[str, Column]:
    have = set(columns)
    out: dict[str, Column] = {}
    if {"AMT_CREDIT", "AMT_INCOME_TOTAL"} <= have:
        out["CREDIT_INCOME_PERC"] = _ratio("AMT_CREDIT", "AMT_INCOME_TOTAL")
    if {"AMT_ANNUITY", "AMT_CREDIT"} <= have:
        out["ANNUITY_CREDIT_PERC"] = _ratio("AMT_ANNUITY", "AMT_CREDIT")
    if {"AMT_GOODS_PRICE", "AMT_CREDIT"} <= have:
        out["GOODS_CREDIT_PERC"] = _ratio("AMT_GOODS_PRICE", "AMT_CREDIT")
    if {"AMT_ANNUITY", "AMT_INCOME_TOTAL"} <= have:
        out["ANNUITY_INCOME_PERC"] = _ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL")
    if "DAYS_BIRTH" in have:
        out["AGE_YEARS"] = -F.col("DAYS_BIRTH") / F.lit(DAYS_PER_YEAR)
    if "DAYS_EMPLOYED" in have:
        years = -F.col("DAYS_EMPLOYED") / F.lit(DAYS_PER_YEAR)
        # clip(lower=0) keeps a missing value missing (greatest() would not).
        out["EMPLOYED_YEARS"] = F.when(years < 0, F.lit(0.0)).otherwise(years)
    return out


def row_stats_exprs(cols: list[str], prefix: str) -> dict[str, Column]:
    """Row-wise mean / sample std / max / min over ``cols`` skipping NULLs
    (std is NULL with fewer than two values)."""
    vals = [F.col(c).cast("double") for c in cols]
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in vals), F.lit(0))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0))
    mean = F.try_divide(total, n)
    sq = sum((F.coalesce((v - mean) * (v - mean), F.lit(0.0)) for v in vals), F.lit(0.0))
    std = F.when(n >= 2, F.sqrt(sq / (n - 1)))
    return {
        f"{prefix}_MEAN": mean,
        f"{prefix}_STD": std,
        f"{prefix}_MAX": F.greatest(*vals) if len(vals) > 1 else vals[0],
        f"{prefix}_MIN": F.least(*vals) if len(vals) > 1 else vals[0],
    }


def with_array_row_stats(df: DataFrame, arr: str, prefix: str) -> DataFrame:
    """F7 over an array column (every element, NULLs skipped): adds
    ``<prefix>_MEAN``, ``_STD`` (sample, NULL below two values), ``_MAX`` and
    ``_MIN`` with array functions, no explode.  The steps are separate
    projections on purpose: a mean referenced inside the deviation lambda
    would be re-aggregated for every element (quadratic per row)."""
    vals, n = f"_{prefix}_vals", f"_{prefix}_n"
    mean = f"{prefix}_MEAN"
    out = df.withColumn(vals, F.filter(F.transform(F.col(arr), lambda x: x.cast("double")),
                                       lambda x: x.isNotNull()))
    out = out.withColumn(n, F.size(vals))
    out = out.withColumn(mean, F.when(F.col(n) > 0, F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
                                      / F.col(n)))
    sq = F.aggregate(vals, F.lit(0.0), lambda a, x: a + (x - F.col(mean)) * (x - F.col(mean)))
    out = out.withColumns({
        f"{prefix}_STD": F.when(F.col(n) >= 2, F.sqrt(sq / (F.col(n) - 1))),
        f"{prefix}_MAX": F.array_max(vals),
        f"{prefix}_MIN": F.array_min(vals),
    })
    return out.drop(vals, n)


def create_ratio_features(df: DataFrame) -> DataFrame:
    """F1-F8 in one projection."""
    exprs = ratio_feature_exprs(df.columns)
    ext = [c for c in df.columns if EXT_SOURCE_RE.match(c)]
    if ext:
        exprs.update(row_stats_exprs(ext, "EXT_SOURCES"))
    docs = [c for c in df.columns if DOCUMENT_RE.match(c)]
    if docs:
        exprs["DOCUMENT_COUNT"] = sum((F.coalesce(F.col(c), F.lit(0)) for c in docs), F.lit(0))
    return df.withColumns(exprs) if exprs else df


def create_interaction_features(df: DataFrame) -> DataFrame:
    """F9-F10."""
    have = set(df.columns)
    exprs = {}
    if {"AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"} <= have:
        exprs["INCOME_PER_PERSON"] = _ratio("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS")
    if {"AMT_CREDIT", "CNT_FAM_MEMBERS"} <= have:
        exprs["CREDIT_PER_PERSON"] = _ratio("AMT_CREDIT", "CNT_FAM_MEMBERS")
    return df.withColumns(exprs) if exprs else df


def engineer_features(df: DataFrame) -> DataFrame:
    return create_interaction_features(create_ratio_features(df))
