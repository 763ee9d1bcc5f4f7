"""Queries: evaluation of scored rows (stand-in: labels x documents)."""

from __future__ import annotations

from kredo.operators import metrics as M
from kredo.plans import standins as S
from kredo.plans.common import register, rnd, rounded

CTE = f"WITH {S.SQL_SCORED}\n"
_D = "CAST({} AS DOUBLE)"
GRID_SQL = (f"grid AS (SELECT i, {_D.format(0.1)} + i * (({_D.format(0.1)} + {_D.format(0.01)})"
            f" - {_D.format(0.1)}) AS threshold FROM range(80) t(i))")


def _prf(tp, fp, fn, tn):
    prec = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0.0)"
    rec = f"coalesce({tp} / nullif({tp} + {fn}, 0), 0.0)"
    return prec, rec


_CM = """c AS (SELECT count(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 END) AS tn,
  count(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 END) AS fp,
  count(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 END) AS fn,
  count(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 END) AS tp FROM scored)"""
_P, _R = _prf("tp", "fp", "fn", "tn")
_METRICS_SELECT = f"""{rnd('coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0)')} AS accuracy,
  {rnd(_P)} AS precision, {rnd(_R)} AS recall,
  {rnd(f'coalesce(2 * {_P} * {_R} / nullif({_P} + {_R}, 0), 0.0)')} AS f1,
  tn, fp, fn, tp, fn * 10 + fp * 1 AS business_cost"""


@register("confusion_metrics", CTE + f", {_CM}\nSELECT {_METRICS_SELECT} FROM c")
def q_confusion_metrics(spark, d):
    return rounded(M.classification_metrics(S.scored(spark, d)))


_AP = """g AS (SELECT y_proba AS s, sum(y_true) AS tp, sum(1 - y_true) AS fp FROM scored
       WHERE y_true IS NOT NULL AND y_proba IS NOT NULL GROUP BY 1),
cu AS (SELECT tp, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(fp) OVER (ORDER BY s DESC) AS cfp FROM g),
ap AS (SELECT coalesce(sum(tp * ctp / (ctp + cfp)) / nullif(sum(tp), 0), 0.0) AS auc_pr FROM cu)"""


@register("average_precision", CTE + f", {_AP}\nSELECT {rnd('auc_pr')} AS auc_pr FROM ap")
def q_average_precision(spark, d):
    return rounded(M.average_precision(S.scored(spark, d)))


_CURVE = f"""{GRID_SQL},
np AS (SELECT count(CASE WHEN y_true = 1 THEN 1 END) AS npos FROM scored),
cv AS (
  SELECT i, threshold,
    count(CASE WHEN y_true = 1 AND (y_proba < threshold OR y_proba IS NULL) THEN 1 END) AS fn,
    count(CASE WHEN y_true = 0 AND y_proba >= threshold THEN 1 END) AS fp,
    count(CASE WHEN y_true = 1 AND y_proba >= threshold THEN 1 END) AS tp
  FROM grid CROSS JOIN scored GROUP BY i, threshold),
curve AS (SELECT cv.*, fn * 10 + fp * 1 AS cost,
    coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
    coalesce(tp / nullif(npos, 0), 0.0) AS recall FROM cv, np)"""


@register("cost_curve", CTE + f""", {_CURVE}
SELECT i, {rnd('threshold')} AS threshold, fn, fp, tp, cost, {rnd('precision')} AS precision,
  {rnd('recall')} AS recall FROM curve""")
def q_cost_curve(spark, d):
    return rounded(M.cost_curve(S.scored(spark, d)))


_OPT = """opt AS (SELECT threshold AS optimal_threshold, cost AS min_business_cost, -cost AS business_score,
  precision AS precision_at_optimal, recall AS recall_at_optimal
  FROM curve ORDER BY cost, i LIMIT 1)"""


@register("optimal_threshold", CTE + f""", {_CURVE}, {_OPT}
SELECT {rnd('optimal_threshold')} AS optimal_threshold, min_business_cost, business_score,
  {rnd('precision_at_optimal')} AS precision_at_optimal, {rnd('recall_at_optimal')} AS recall_at_optimal
FROM opt""")
def q_optimal_threshold(spark, d):
    return rounded(M.find_optimal_threshold(S.scored(spark, d)))


@register("evaluate_model", CTE + f""", {_CM}, {_AP}, {_CURVE}, {_OPT}
SELECT {_METRICS_SELECT}, {rnd('auc_pr')} AS auc_pr,
  {rnd('optimal_threshold')} AS optimal_threshold, min_business_cost, business_score,
  {rnd('precision_at_optimal')} AS precision_at_optimal, {rnd('recall_at_optimal')} AS recall_at_optimal
FROM c, ap, opt""")
def q_evaluate_model(spark, d):
    return rounded(M.evaluate_model(S.scored(spark, d)))


@register("cost_at_threshold", CTE + """SELECT
  count(CASE WHEN y_true = 1 AND NOT (y_proba >= 0.5) THEN 1 END) * 10
  + count(CASE WHEN y_true = 0 AND y_proba >= 0.5 THEN 1 END) * 1 AS business_cost FROM scored""")
def q_cost_at_threshold(spark, d):
    return M.business_cost_from_proba(S.scored(spark, d), 0.5)
