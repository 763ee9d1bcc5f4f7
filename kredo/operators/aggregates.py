"""Declarative per-key aggregate specs.

``agg_by_key`` turns ``{column: [fn, ...]}`` into one ``groupBy(key).agg``
call: one hash aggregate with map-side partial aggregation, so a hot key is
pre-combined in every task before the shuffle and never lands whole in one
buffer.  ``nunique`` becomes an exact ``count(DISTINCT)``; Spark plans it as
a two-level aggregate keyed by (key, value), which also spreads a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

KEY = "SK_ID_CURR"

# The per-table aggregate specs and output prefixes of the
# credit feature build (output column = <prefix>_<COLUMN>_<fn>).
BUREAU_SPEC = {
    "SK_ID_BUREAU": ["count"],
    "DAYS_CREDIT": ["min", "max", "mean"],
    "CREDIT_DAY_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_MAX_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_SUM": ["sum", "mean", "max"],
    "AMT_CREDIT_SUM_DEBT": ["sum", "mean"],
    "AMT_CREDIT_SUM_OVERDUE": ["sum", "mean"],
    "AMT_ANNUITY": ["sum", "mean"],
}
PREVIOUS_SPEC = {
    "SK_ID_PREV": ["count"],
    "AMT_ANNUITY": ["sum", "mean", "min", "max"],
    "AMT_APPLICATION": ["sum", "mean", "min", "max"],
    "AMT_CREDIT": ["sum", "mean", "min", "max"],
    "DAYS_DECISION": ["min", "max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
}
POS_CASH_SPEC = {
    "SK_ID_PREV": ["count"],
    "MONTHS_BALANCE": ["min", "max", "mean"],
    "CNT_INSTALMENT": ["mean", "sum"],
    "CNT_INSTALMENT_FUTURE": ["mean", "sum"],
    "SK_DPD": ["max", "mean"],
    "SK_DPD_DEF": ["max", "mean"],
}
CREDIT_CARD_SPEC = {
    "SK_ID_PREV": ["count"],
    "MONTHS_BALANCE": ["min", "max", "mean"],
    "AMT_BALANCE": ["sum", "mean", "max"],
    "AMT_CREDIT_LIMIT_ACTUAL": ["sum", "mean", "max"],
    "AMT_DRAWINGS_ATM_CURRENT": ["sum", "mean"],
    "AMT_DRAWINGS_CURRENT": ["sum", "mean"],
    "AMT_PAYMENT_CURRENT": ["sum", "mean"],
    "CNT_DRAWINGS_ATM_CURRENT": ["sum", "mean"],
    "CNT_DRAWINGS_CURRENT": ["sum", "mean"],
}
INSTALLMENTS_SPEC = {
    "SK_ID_PREV": ["count"],
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "NUM_INSTALMENT_NUMBER": ["max", "mean"],
    "DAYS_INSTALMENT": ["min", "max", "mean"],
    "DAYS_ENTRY_PAYMENT": ["min", "max", "mean"],
    "AMT_INSTALMENT": ["sum", "mean", "min", "max"],
    "AMT_PAYMENT": ["sum", "mean", "min", "max"],
    "PAYMENT_PERC": ["mean", "min"],
    "PAYMENT_DIFF": ["sum", "mean"],
    "DPD": ["max", "mean"],
}
PREFIX = {"bureau": "bureau", "previous": "prev", "pos_cash": "pos",
          "credit_card": "cc", "installments": "inst"}


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns (schema metadata only, no job)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _agg_expr(column: str, fn: str, approx_distinct: float | None = None):
    c = F.col(column)
    if fn == "count":
        return F.count(c)
    if fn == "nunique":
        # exact: a two-level aggregate (shuffle by key and value); approx:
        # a HyperLogLog++ sketch merged in the same single aggregate
        return F.approx_count_distinct(c, approx_distinct) if approx_distinct else F.count_distinct(c)
    if fn == "sum":
        # pandas sums an all-missing group to 0; Spark gives NULL.
        return F.coalesce(F.sum(c), F.lit(0))
    if fn == "mean":
        return F.avg(c)
    if fn == "min":
        return F.min(c)
    if fn == "max":
        return F.max(c)
    raise ValueError(f"unknown aggregate function {fn!r}")


def agg_by_key(df: DataFrame, spec: dict[str, list[str]], prefix: str,
               key: str = KEY, approx_distinct: float | None = None) -> DataFrame | None:
    """``groupBy(key).agg`` over the columns of ``spec`` that exist and are
    numeric; returns ``None`` when none is left (caller skips the table).
    ``approx_distinct`` (a relative standard deviation such as 0.01) turns
    ``nunique`` into ``approx_count_distinct``."""
    numeric = set(numeric_columns(df))
    exprs = [_agg_expr(col, fn, approx_distinct).alias(f"{prefix}_{col}_{fn}")
             for col, fns in spec.items() if col in numeric and col != key
             for fn in fns]
    if not exprs:
        return None
    # pandas drops rows with a missing group key; Spark would keep a NULL group.
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*exprs)


def aggregate_bureau(df: DataFrame) -> DataFrame | None:
    return agg_by_key(df, BUREAU_SPEC, PREFIX["bureau"])


def aggregate_previous(df: DataFrame) -> DataFrame | None:
    return agg_by_key(df, PREVIOUS_SPEC, PREFIX["previous"])


def aggregate_pos_cash(df: DataFrame) -> DataFrame | None:
    return agg_by_key(df, POS_CASH_SPEC, PREFIX["pos_cash"])


def aggregate_credit_card(df: DataFrame) -> DataFrame | None:
    return agg_by_key(df, CREDIT_CARD_SPEC, PREFIX["credit_card"])


def with_installment_derivations(df: DataFrame) -> DataFrame:
    """F11-F13.  PAYMENT_PERC with a zero amount due is NULL (try_divide)
    instead of infinity."""
    required = {"AMT_PAYMENT", "AMT_INSTALMENT", "DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT"}
    missing = required - set(df.columns)
    if missing:
        raise KeyError(f"installments table lacks columns {sorted(missing)}")
    return df.withColumns({
        "PAYMENT_PERC": F.try_divide(F.col("AMT_PAYMENT"), F.col("AMT_INSTALMENT")),
        "PAYMENT_DIFF": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
        "DPD": F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"),
    })


def aggregate_installments(df: DataFrame, approx_distinct: float | None = None) -> DataFrame | None:
    return agg_by_key(with_installment_derivations(df), INSTALLMENTS_SPEC,
                      PREFIX["installments"], approx_distinct=approx_distinct)


AGGREGATORS = {
    "bureau": aggregate_bureau,
    "previous": aggregate_previous,
    "pos_cash": aggregate_pos_cash,
    "credit_card": aggregate_credit_card,
    "installments": aggregate_installments,
}
