"""Data drift.

Both sides are reduced to per-feature profiles first (one aggregation pass
each); the comparison is a join of two tables with one row per feature -
their size is bounded by the schema width, never by the data, so they are
broadcast safely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from kredo.functions.numeric import number_of
from kredo.operators.encoding import canonical_yes_no
from kredo.functions.bands import SEVERITY_MILD, SEVERITY_SEVERE, drift_severity, drift_status
from kredo.operators.profile import category_profile, numeric_profile

# The monitored application fields (in display order) and the
# numeric ones among them.
MONITORED_INPUT_FIELDS = [
    "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "CNT_CHILDREN", "AMT_INCOME_TOTAL",
    "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "NAME_EDUCATION_TYPE",
    "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "DAYS_BIRTH", "DAYS_EMPLOYED",
    "OCCUPATION_TYPE", "CNT_FAM_MEMBERS", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
]
NUMERIC_MONITORED_FIELDS = {
    "CNT_CHILDREN", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE",
    "DAYS_BIRTH", "DAYS_EMPLOYED", "CNT_FAM_MEMBERS", "EXT_SOURCE_1", "EXT_SOURCE_2",
    "EXT_SOURCE_3",
}
ID_COLUMNS = {"SK_ID_CURR", "SK_ID", "ID", "CNT_CHILDREN_"}
EPS = 1e-6
DEFAULT_DRIFT_THRESHOLD = 0.05


def _order_col(fields: list[str]):
    """Position of the feature in ``fields`` (for a stable display order)."""
    return F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("feature"))


def compare_fields(recent: DataFrame, reference: DataFrame,
                   fields: list[str] | None = None,
                   numeric: set[str] | None = None) -> DataFrame:
    """D2 detail: one row per shared monitored field present on both sides.

    numeric: change = |mean_r - mean_ref| / |mean_ref| (absolute change when
    |mean_ref| <= 1e-6); categorical: same dominant value -> relative change
    of its share (denominator at least 1e-6), different value -> 1.0."""
    fields = list(MONITORED_INPUT_FIELDS if fields is None else fields)
    shared = [f for f in fields if f in recent.columns and f in reference.columns]
    both = (recent.select(*_typed(recent, shared, numeric), F.lit("recent").alias("_side"))
            .unionByName(reference.select(*_typed(reference, shared, numeric),
                                          F.lit("reference").alias("_side"))))
    return _compare(both, shared, fields, numeric)


def _typed(df: DataFrame, fields: list[str], numeric: set[str] | None) -> list:
    """The fields as one side of a comparison: numeric ones as doubles (what is
    no number becomes NULL), yes/no flags as Y/N whether they come as 1/0 or
    text, all others as text - so that a text payload meets a typed table."""
    numeric = NUMERIC_MONITORED_FIELDS if numeric is None else numeric
    out = []
    for f in fields:
        text = F.col(f).cast("string")
        if f in numeric:
            c = number_of(df, f)
        elif f.startswith("FLAG_OWN_"):
            c = F.coalesce(canonical_yes_no(f), text)
        else:
            c = text
        out.append(c.alias(f))
    return out


def compare_split(df: DataFrame, is_recent, fields: list[str] | None = None,
                  numeric: set[str] | None = None) -> DataFrame:
    """D2 when both sides come from ONE table split by a predicate: the side
    is a column, so every profile is one scan grouped by side (a union of
    two filtered reads would scan the table twice)."""
    fields = list(MONITORED_INPUT_FIELDS if fields is None else fields)
    shared = [f for f in fields if f in df.columns]
    tagged = df.select(*_typed(df, shared, numeric), F.when(is_recent, "recent").otherwise("reference").alias("_side"))
    return _compare(tagged, shared, fields, numeric)


def _side_pivot(prof: DataFrame, stats: tuple[str, ...]) -> DataFrame:
    """One row per feature with ``r_<stat>`` (recent) and ``f_<stat>``
    (reference).  The input has two rows per feature - bounded by the
    schema width - so this small aggregate is cheap."""
    side = F.col("_side")
    return prof.groupBy("feature").agg(*[
        F.max(F.when(side == name, F.col(c))).alias(f"{p}_{c}")
        for name, p in (("recent", "r"), ("reference", "f")) for c in stats])


def _compare(both: DataFrame, shared: list[str], fields: list[str],
             numeric: set[str] | None) -> DataFrame:
    return differences(*_profiles(both, shared, numeric), fields)


def _profiles(tagged: DataFrame, shared: list[str], numeric: set[str] | None) -> tuple:
    numeric = NUMERIC_MONITORED_FIELDS if numeric is None else numeric
    num = [f for f in shared if f in numeric]
    cat = [f for f in shared if f not in numeric]
    return (numeric_profile(tagged, num, ["_side"]) if num else None,
            category_profile(tagged, cat, ["_side"]) if cat else None)


def side_profiles(df: DataFrame, side: str, fields: list[str] | None = None,
                  numeric: set[str] | None = None) -> tuple:
    """(numeric, category) profiles of one side, ``recent`` or ``reference``, from its
    ``typed_fields``, None without fields of that kind: one row per feature, to be kept
    and compared with many other sides by ``differences``."""
    fields = list(MONITORED_INPUT_FIELDS if fields is None else fields)
    shared = [f for f in fields if f in df.columns]
    return _profiles(df.withColumn("_side", F.lit(side)), shared, numeric)


def typed_fields(df: DataFrame, fields: list[str] | None = None, numeric: set[str] | None = None,
                 keep: list[str] | tuple = ()) -> DataFrame:
    """The monitored fields that are there as a side of a comparison has them."""
    fields = list(MONITORED_INPUT_FIELDS if fields is None else fields)
    return df.select(*keep, *_typed(df, [f for f in fields if f in df.columns], numeric))


def differences(num: DataFrame | None, cat: DataFrame | None, fields: list[str] | None = None) -> DataFrame:
    """D2 details from profiles that hold both sides, told apart by ``_side``."""
    fields = list(MONITORED_INPUT_FIELDS if fields is None else fields)
    parts = []
    if num is not None:
        j = _side_pivot(num, ("mean", "std", "min", "max", "count"))
        j = j.where((F.coalesce(F.col("r_count"), F.lit(0)) > 0)
                    & (F.coalesce(F.col("f_count"), F.lit(0)) > 0))
        diff = F.abs(F.col("r_mean") - F.col("f_mean"))
        change = F.when(F.abs(F.col("f_mean")) > EPS, diff / F.abs(F.col("f_mean"))).otherwise(diff)
        parts.append(j.select(
            "feature", F.lit("numeric").alias("comparison_type"),
            F.col("f_mean").alias("avg_reference"), F.col("r_mean").alias("avg_recent"),
            change.alias("change"),
            F.col("f_std").alias("ref_std"), F.col("f_min").alias("ref_min"),
            F.col("f_max").alias("ref_max"),
            F.format_string("mean = %.4f", F.col("f_mean")).alias("reference_display"),
            F.format_string("mean = %.4f", F.col("r_mean")).alias("recent_display")))
    if cat is not None:
        j = _side_pivot(cat, ("top_value", "top_share"))
        j = j.where(F.col("r_top_value").isNotNull() & F.col("f_top_value").isNotNull())
        same = F.col("r_top_value") == F.col("f_top_value")
        change = F.when(same, F.abs(F.col("r_top_share") - F.col("f_top_share"))
                        / F.greatest(F.col("f_top_share"), F.lit(EPS))).otherwise(F.lit(1.0))
        parts.append(j.select(
            "feature", F.lit("categorical").alias("comparison_type"),
            F.col("f_top_share").alias("avg_reference"), F.col("r_top_share").alias("avg_recent"),
            change.alias("change"),
            F.lit(0.0).alias("ref_std"), F.lit(0.0).alias("ref_min"), F.lit(0.0).alias("ref_max"),
            F.format_string("dominant = %s (%.1f%%)", F.col("f_top_value"), F.col("f_top_share") * 100)
            .alias("reference_display"),
            F.format_string("dominant = %s (%.1f%%)", F.col("r_top_value"), F.col("r_top_share") * 100)
            .alias("recent_display")))
    if not parts:
        raise ValueError("no monitored field on both sides")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("*", (F.col("change") * 100).alias("change_pct"),
                      drift_status("change").alias("status_code"),
                      _order_col(fields).alias("position"))


def drift_summary(details: DataFrame, recent: DataFrame,
                  threshold: float = DEFAULT_DRIFT_THRESHOLD) -> DataFrame:
    """D2 result: drift score = mean change; drift when score > threshold;
    N12: affected (non-ok) features, sorted."""
    n_recent = recent.agg(F.count(F.lit(1))).scalar()
    return drift_verdict(details, threshold).withColumn("recent_sample_size", n_recent)


def drift_verdict(details: DataFrame, threshold: float = DEFAULT_DRIFT_THRESHOLD) -> DataFrame:
    """``drift_summary`` from the details alone, without the recent side's count."""
    return details.agg(
        F.coalesce(F.avg("change"), F.lit(0.0)).alias("drift_score"),
        F.count(F.lit(1)).alias("num_features_analyzed"),
        F.array_sort(F.collect_list(F.when(F.col("status_code") != "ok", F.col("feature"))))
        .alias("affected_features"),
    ).select("*", (F.col("drift_score") > F.lit(threshold)).alias("has_drift"),
             F.lit(threshold).alias("threshold"))


def status_counts(details: DataFrame) -> DataFrame:
    """A25."""
    return details.groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))


def top_drifting(details: DataFrame, n: int = 10) -> DataFrame:
    """O3: top features by change, ranked on the change rounded to 6 decimals
    (float noise must not decide between equal changes), ties by name."""
    from kredo.functions.numeric import round_half
    return details.orderBy(round_half(F.col("change_pct"), 6).desc(), F.col("feature")).limit(n)


def monitored_numeric(df: DataFrame, exclude: set[str] = ID_COLUMNS,
                      max_cols: int | None = None) -> tuple[list[str], int]:
    """Numeric non-ID columns (schema order), all of them or the first
    ``max_cols``; also the count before that limit."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]
    return (cols[:max_cols] if max_cols else cols), len(cols)


def mean_shift(recent: DataFrame, reference: DataFrame, max_cols: int | None = None,
               exclude: set[str] = ID_COLUMNS, signed: bool = False) -> DataFrame:
    """D1 detail (D4 with ``signed=True``: (cur - ref) / |ref| * 100).
    Columns whose |reference mean| <= 1e-6 are skipped.  When both sides are parts of
    one table, ``mean_shift_split`` reads it once."""
    cols, _ = monitored_numeric(recent, exclude, max_cols)
    cols = [c for c in cols if c in reference.columns]
    both = (recent.select(*[number_of(recent, c).alias(c) for c in cols], F.lit("recent").alias("_side"))
            .unionByName(reference.select(*[number_of(reference, c).alias(c) for c in cols],
                                          F.lit("reference").alias("_side"))))
    return _shifts(both, cols, signed)


def mean_shift_split(df: DataFrame, is_recent, max_cols: int | None = None, exclude: set[str] = ID_COLUMNS,
                     signed: bool = False) -> DataFrame:
    """``mean_shift`` of one table split by a predicate, in one scan."""
    cols, _ = monitored_numeric(df, exclude, max_cols)
    side = F.when(is_recent, "recent").otherwise("reference")
    return _shifts(df.select(*[number_of(df, c).alias(c) for c in cols], side.alias("_side")), cols, signed)


def _shifts(both: DataFrame, cols: list[str], signed: bool) -> DataFrame:
    # both sides are means of the same aggregate, grouped by side
    j = _side_pivot(numeric_profile(both, cols, ["_side"]), ("mean",)).select(
        "feature", F.col("r_mean").alias("current_mean"), F.col("f_mean").alias("reference_mean"))
    j = j.where((F.abs(F.col("reference_mean")) > EPS) & F.col("current_mean").isNotNull())
    delta = F.col("current_mean") - F.col("reference_mean")
    if signed:
        return j.select("feature", "reference_mean", "current_mean",
                        (delta / F.abs(F.col("reference_mean")) * 100).alias("variation_pct"))
    var = F.abs(delta / F.col("reference_mean"))
    return j.select("feature", "reference_mean", "current_mean", var.alias("variation_ratio"),
                    drift_severity(var).alias("severity"))


def mean_shift_summary(details: DataFrame, total_monitored: int) -> DataFrame:
    """D1 verdict: >= 2 columns above 50 % -> severe; else > 6 above 30 % ->
    severe; else >= 4 above 30 % -> warning (not a detected drift)."""
    v = F.col("variation_ratio")
    c = details.agg(F.count_if(v > SEVERITY_SEVERE).alias("drift_columns_50pct"),
                    F.count_if(v > SEVERITY_MILD).alias("drift_columns_30pct"))
    n50, n30 = F.col("drift_columns_50pct"), F.col("drift_columns_30pct")
    sev = (F.when(n50 >= 2, "severe").when(n30 > 6, "severe").when(n30 >= 4, "warning")
           .otherwise("none"))
    return c.select((sev == "severe").alias("drift_detected"), sev.alias("drift_severity"),
                    n30, n50, F.lit(total_monitored).alias("total_monitored"))


def detect_drift(logs: DataFrame, reference: DataFrame, as_of: str | None = None,
                 last_n_hours: int = 24, threshold: float = DEFAULT_DRIFT_THRESHOLD,
                 fields: list[str] | None = None, numeric: set[str] | None = None):
    """D3: payloads of the last ``last_n_hours`` of the log (N1/N2) compared
    with the reference table (D2).  Returns (details, summary); recording
    (S11) and the drift alert (X3) are left to the caller's sinks."""
    from kredo.functions.payload import payload_frame
    from kredo.operators.logstats import recent
    fields = list(MONITORED_INPUT_FIELDS if fields is None else fields)
    recent_rows = payload_frame(recent(logs, as_of, last_n_hours), "input_data", fields=fields)
    details = compare_fields(recent_rows, reference, fields, numeric)
    return details, drift_summary(details, recent_rows, threshold)
