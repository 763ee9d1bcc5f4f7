"""Standard / min-max scaling fitted on the training frame.

Fitting is one aggregate over all columns (population std, like the
reference - Spark ML's StandardScaler uses the sample std and its
MinMaxScaler maps constants to 0.5, so neither is used).  The fitted
parameters are a handful of numbers per column, bounded by the schema; they
are collected once and applied as literals inside one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("standard", "minmax")


def assert_no_missing(df: DataFrame, cols: list[str]) -> None:
    """Raise if any NULL/NaN value is present (one aggregate)."""
    checks = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in cols]
    row = df.agg(*checks).first()
    bad = {c: row[c] for c in cols if row[c]}
    if bad:
        raise ValueError(f"missing values in {bad}")


def fit_scaler(train: DataFrame, cols: list[str], method: str = "standard",
               check_missing: bool = True) -> dict[str, dict[str, float]]:
    if method not in METHODS:
        raise ValueError(f"unknown scaling method {method!r}; use one of {METHODS}")
    if check_missing:
        assert_no_missing(train, cols)
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"{c}__mean"), F.stddev_pop(v).alias(f"{c}__std"),
                 F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
    row = train.agg(*aggs).first()
    return {c: {s: row[f"{c}__{s}"] for s in ("mean", "std", "min", "max")} for c in cols}


def apply_scaler(df: DataFrame, params: dict[str, dict[str, float]],
                 method: str = "standard", suffix: str = "") -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown scaling method {method!r}; use one of {METHODS}")
    out = {}
    for c, p in params.items():
        v = F.col(c).cast("double")
        if method == "standard":
            std = p["std"] if p["std"] else 1.0     # constant column -> 0
            out[c + suffix] = (v - F.lit(p["mean"])) / F.lit(std)
        else:
            rng = (p["max"] - p["min"]) if p["max"] != p["min"] else 1.0
            out[c + suffix] = (v - F.lit(p["min"])) / F.lit(rng)   # test not clipped
    return df.withColumns(out)


def scale_features(train: DataFrame, test: DataFrame | None = None, method: str = "standard",
                   cols: list[str] | None = None):
    """Fit on ``train`` only, apply to both; returns (train, test, params)."""
    from kredo.operators.aggregates import numeric_columns
    cols = cols or numeric_columns(train)
    params = fit_scaler(train, cols, method)
    return (apply_scaler(train, params, method),
            apply_scaler(test, params, method) if test is not None else None, params)
