"""Banding of a score or change ratio into labels.

One generic ``band`` (a CASE chain, codegen'd) and the reference's schemes as
fixed cut/label tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(col: Column | str, cuts: list[float], labels: list[str],
         closed: str = "left", null_label: str | None = None) -> Column:
    """Label ``col`` by ascending ``cuts`` (len(labels) == len(cuts) + 1).

    closed="left": bucket i holds cuts[i-1] <= x < cuts[i] (test ``x < cut``);
    closed="right": bucket i holds cuts[i-1] < x <= cuts[i] (test ``x <= cut``).
    A NULL input gets ``null_label`` (default: the last label, like a SQL
    CASE whose ELSE also catches NULL)."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one more label than cuts")
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for cut, label in zip(cuts, labels):
        test = c < F.lit(cut) if closed == "left" else c <= F.lit(cut)
        expr = F.when(test, label) if expr is None else expr.when(test, label)
    out = expr.otherwise(labels[-1])
    if null_label is not None:
        out = F.when(c.isNull(), null_label).otherwise(out)
    return out


# Cut points and labels of the reference's banding schemes.
RISK_BUCKET_CUTS = [0.2, 0.4, 0.6, 0.8]
RISK_BUCKET_LABELS = ["0.0-0.2 (Very Low Risk)", "0.2-0.4 (Low Risk)", "0.4-0.6 (Medium Risk)",
                      "0.6-0.8 (High Risk)", "0.8-1.0 (Very High Risk)"]
TYPE_RISK_CUTS = [0.45, 0.6]                 # low <= .45 < medium <= .6 < high
TYPE_RISK_LABELS = ["low", "medium", "high"]
DECISION_RISK_CUTS = [0.3, 0.6]              # low < .3 <= medium < .6 <= high
DECISION_RISK_LABELS = ["low", "medium", "high"]
HISTORY_RISK_CUTS = [0.45, 0.6]              # low < .45 <= medium < .6 <= high
HISTORY_RISK_LABELS = ["low", "medium", "high"]
HISTORY_REFUSE_AT = 0.6
DOC_BAND_CUTS = [0.25, 0.45, 0.60, 0.80]
DOC_BAND_LABELS = ["very_good", "good", "moderate", "high", "very_high"]
DRIFT_STATUS = (0.05, 0.15, 0.25)            # ok <= .05 < low < .15 <= medium < .25 <= critical
SEVERITY_MILD, SEVERITY_SEVERE = 0.30, 0.50  # normal <= .3 < mild <= .5 < severe


def risk_bucket(score: Column | str) -> Column:
    """five buckets, left-closed; NULL falls into the last bucket."""
    return band(score, RISK_BUCKET_CUTS, RISK_BUCKET_LABELS, "left")


def type_risk(score: Column | str) -> Column:
    """high > .6, medium (.45, .6], low <= .45; NULL -> NULL."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c.isNotNull(), band(c, TYPE_RISK_CUTS, TYPE_RISK_LABELS, "right"))


def decision(score: Column | str, threshold: float) -> Column:
    """accept below the threshold, refuse at or above it."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c < F.lit(threshold), "accept").when(c.isNotNull(), "refuse")


def decision_risk(score: Column | str) -> Column:
    """risk < .3 low, < .6 medium, else high."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c.isNotNull(), band(c, DECISION_RISK_CUTS, DECISION_RISK_LABELS, "left"))


def history_risk(score: Column | str) -> Column:
    """>= .6 high, >= .45 medium, else low."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c.isNotNull(), band(c, HISTORY_RISK_CUTS, HISTORY_RISK_LABELS, "left"))


def history_decision(score: Column | str) -> Column:
    """refuse at >= .6, else accept."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c >= F.lit(HISTORY_REFUSE_AT), "refuse").when(c.isNotNull(), "accept")


def doc_band(score: Column | str) -> Column:
    """the documented five bands .25 .45 .60 .80."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c.isNotNull(), band(c, DOC_BAND_CUTS, DOC_BAND_LABELS, "left"))


def drift_status(change: Column | str) -> Column:
    """<= .05 ok, < .15 low, < .25 medium, else critical."""
    c = F.col(change) if isinstance(change, str) else change
    ok, low, med = DRIFT_STATUS
    return (F.when(c <= F.lit(ok), "ok").when(c < F.lit(low), "low")
            .when(c < F.lit(med), "medium").otherwise("critical"))


def drift_severity(variation: Column | str) -> Column:
    """> .5 severe, > .3 mild, else normal."""
    c = F.col(variation) if isinstance(variation, str) else variation
    return (F.when(c > F.lit(SEVERITY_SEVERE), "severe")
            .when(c > F.lit(SEVERITY_MILD), "mild").otherwise("normal"))
