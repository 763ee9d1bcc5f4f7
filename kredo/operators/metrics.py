"""Model evaluation.

Inputs are one DataFrame ``(id, y_true, y_pred, y_proba)`` - never
positional arrays.  Every metric is a single pass:

* confusion counts are four ``count_if`` in one aggregate;
* the threshold sweep does not evaluate the cost once per threshold (80 full
  passes or an 80x cross join): each row is mapped to the number of grid
  thresholds at or below its probability (a binary-search CASE tree, about
  7 comparisons), rows are grouped by that number
  (at most len(grid)+1 groups, pre-combined in every task), and the whole
  cost curve follows from running sums over those few groups;
* average precision needs running sums over distinct scores in descending
  order; they come from the bucketed ``running_totals`` (no global window).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kredo.operators.ordered import running_totals

# Default error costs (a false negative costs ten false
# positives) and the default threshold grid 0.10, 0.11, ... 0.89.
COST_FN = 10
COST_FP = 1
GRID_START, GRID_STOP, GRID_STEP = 0.1, 0.9, 0.01


def threshold_grid(start: float = GRID_START, stop: float = GRID_STOP,
                   step: float = GRID_STEP) -> list[float]:
    """Same doubles as an arange: start + i * ((start + step) - start)."""
    n = math.ceil((stop - start) / step)
    delta = (start + step) - start
    return [start + i * delta for i in range(n)]


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row tn, fp, fn, tp (labels taken as 0/1; missing labels are
    not counted)."""
    t, p = F.col(y_true), F.col(y_pred)
    return df.agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    )


def _safe_div(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                           cost_fn: float = COST_FN, cost_fp: float = COST_FP) -> DataFrame:
    """A16 + A17 + A19: accuracy, precision, recall, F1 (zero division -> 0),
    confusion counts and business cost, in one aggregate."""
    c = confusion(df, y_true, y_pred)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    precision = _safe_div(tp, tp + fp)
    recall = _safe_div(tp, tp + fn)
    return c.select(
        _safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _safe_div(2 * precision * recall, precision + recall).alias("f1"),
        "tn", "fp", "fn", "tp",
        (fn * F.lit(cost_fn) + fp * F.lit(cost_fp)).alias("business_cost"),
    )


def business_cost(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                  cost_fn: float = COST_FN, cost_fp: float = COST_FP) -> DataFrame:
    """FN * cost_fn + FP * cost_fp."""
    t, p = F.col(y_true), F.col(y_pred)
    return df.agg((F.count_if((t == 1) & (p == 0)) * F.lit(cost_fn)
                   + F.count_if((t == 0) & (p == 1)) * F.lit(cost_fp)).alias("business_cost"))


def business_cost_from_proba(df: DataFrame, threshold: float = 0.5, y_true: str = "y_true",
                             y_proba: str = "y_proba", cost_fn: float = COST_FN,
                             cost_fp: float = COST_FP) -> DataFrame:
    """The same with prediction = proba >= threshold."""
    pred = F.when(F.col(y_proba) >= F.lit(threshold), 1).otherwise(0)
    return business_cost(df.withColumn("_pred", pred), y_true, "_pred", cost_fn, cost_fp)


def average_precision(df: DataFrame, y_true: str = "y_true", y_proba: str = "y_proba") -> DataFrame:
    """Sum over distinct scores (descending) of (R_n - R_(n-1)) * P_n,
    i.e. (1/npos) * sum(tp_s * P_s).  No positive -> 0.  As in the cost curve, a row
    without a score is never accepted: its positive counts in npos alone."""
    t = F.col(y_true)
    unscored = F.lit(float("-inf"))
    rt = running_totals(df.where(t.isNotNull()).withColumn(y_proba, F.coalesce(F.col(y_proba).cast("double"), unscored)), y_proba,
                        {"tp": t.cast("long"), "fp": (F.lit(1) - t).cast("long")},
                        descending=True)
    contrib = F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    contrib = F.when(F.col(y_proba) > unscored, contrib)
    return rt.agg(F.coalesce(F.try_divide(F.sum(contrib), F.sum("tp")), F.lit(0.0)).alias("auc_pr"))


def count_at_or_below(p, grid: list[float]):
    """Number of values of the sorted ``grid`` that are <= p, as a balanced
    binary-search CASE tree: log2(len) comparisons per row, codegen'd, exact
    for any grid.  NULL p gives 0."""
    def node(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(p >= F.lit(float(grid[mid])), node(mid + 1, hi)).otherwise(node(lo, mid))
    return node(0, len(grid))


def cost_curve(df: DataFrame, thresholds: list[float] | None = None, y_true: str = "y_true",
               y_proba: str = "y_proba", cost_fn: float = COST_FN,
               cost_fp: float = COST_FP) -> DataFrame:
    """A21 curve: one row per distinct threshold with its position ``i`` in
    the given list (the default grid is ascending, so i = rank) and fn, fp,
    tp, cost, precision, recall.

    k(row) = #{thresholds <= proba}; the row is predicted positive exactly
    for thresholds i < k.  So FN_i = positives with k <= i and
    FP_i = negatives with k > i."""
    given = list(thresholds) if thresholds is not None else threshold_grid()
    # position of each distinct threshold in the caller's order (a repeated
    # value keeps its first position): the argmin breaks ties by it
    first_pos: dict[float, int] = {}
    for pos_, t in enumerate(given):
        first_pos.setdefault(float(t), pos_)
    grid = sorted(first_pos)
    order_of = [first_pos[t] for t in grid]
    n = len(grid)
    garr = F.array(*[F.lit(float(t)) for t in grid])
    p, t = F.col(y_proba), F.col(y_true)
    k = count_at_or_below(p, grid)
    counts = (df.where(t.isNotNull())
              .groupBy(F.when(p.isNull(), 0).otherwise(k).alias("k"))
              .agg(F.count_if(t == 1).alias("pos"), F.count_if(t == 0).alias("neg")))
    spark: SparkSession = df.sparkSession
    # grid positions 0..n (bounded by the grid, not by the data)
    pos = spark.range(n + 1).withColumnRenamed("id", "k")
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = (pos.join(counts.withColumn("k", F.col("k").cast("long")), "k", "left")
           .na.fill(0, ["pos", "neg"])
           .select("k", F.sum("pos").over(w).alias("cpos"), F.sum("neg").over(w).alias("cneg"),
                   F.sum("pos").over(Window.partitionBy()).alias("npos"),
                   F.sum("neg").over(Window.partitionBy()).alias("nneg")))
    fn = F.col("cpos")
    fp = F.col("nneg") - F.col("cneg")
    tp = F.col("npos") - F.col("cpos")
    oarr = F.array(*[F.lit(o) for o in order_of])
    return cum.where(F.col("k") < n).select(
        F.element_at(oarr, (F.col("k") + 1).cast("int")).cast("long").alias("i"),
        F.element_at(garr, (F.col("k") + 1).cast("int")).alias("threshold"),
        fn.alias("fn"), fp.alias("fp"), tp.alias("tp"),
        (fn * F.lit(cost_fn) + fp * F.lit(cost_fp)).alias("cost"),
        _safe_div(tp, tp + fp).alias("precision"),
        _safe_div(tp, F.col("npos")).alias("recall"),
    )


def optimal_threshold(curve: DataFrame) -> DataFrame:
    """A21/A22/A23 + O10: the first threshold with the minimum cost, its
    cost, the business score (-cost) and precision/recall at it."""
    best = F.min_by(F.struct("threshold", "cost", "precision", "recall"),
                    F.struct("cost", "i")).alias("b")
    return curve.agg(best).select(
        F.col("b.threshold").alias("optimal_threshold"),
        F.col("b.cost").alias("min_business_cost"),
        (-F.col("b.cost")).alias("business_score"),
        F.col("b.precision").alias("precision_at_optimal"),
        F.col("b.recall").alias("recall_at_optimal"),
    )


def find_optimal_threshold(df: DataFrame, **kw) -> DataFrame:
    return optimal_threshold(cost_curve(df, **kw))


def evaluate_model(df: DataFrame, cost_fn: float = COST_FN, cost_fp: float = COST_FP,
                   with_proba: bool = True) -> DataFrame:
    """A17 report: classification metrics, plus AUC-PR and the optimal
    threshold block when probabilities are given (scalar subqueries: each
    part is its own small aggregate)."""
    m = classification_metrics(df, cost_fn=cost_fn, cost_fp=cost_fp)
    if not with_proba:
        return m
    ap = average_precision(df)
    opt = find_optimal_threshold(df, cost_fn=cost_fn, cost_fp=cost_fp)
    o = opt.select(F.struct(*opt.columns)).scalar()          # one subquery
    return m.select("*", ap.scalar().alias("auc_pr"), *[o[c].alias(c) for c in opt.columns])
