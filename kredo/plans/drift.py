"""Queries: profiles and drift (stand-ins: applications split by date,
events payload split by time)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kredo.functions.payload import payload_frame
from kredo.operators import drift as D
from kredo.operators import profile as P
from kredo.plans import standins as S
from kredo.plans.common import register, rnd, rounded

SPLIT = S.APPLICATION_SPLIT
NUM = [f for f in D.MONITORED_INPUT_FIELDS if f in D.NUMERIC_MONITORED_FIELDS and f != "CNT_CHILDREN"]
CAT = [f for f in D.MONITORED_INPUT_FIELDS if f not in D.NUMERIC_MONITORED_FIELDS]
FIELDS_SQL = "[" + ", ".join(f"'{f}'" for f in D.MONITORED_INPUT_FIELDS) + "]"


def _split(spark, d):
    """All applications, and the predicate of the recent ones."""
    return S.applications(spark, d), F.col("APPLICATION_DATE") >= F.lit(SPLIT).cast("date")


_SIDES = f"""{S.SQL_APPLICATIONS},
ref AS (SELECT * FROM applications WHERE APPLICATION_DATE < DATE '{SPLIT}'),
rec AS (SELECT * FROM applications WHERE APPLICATION_DATE >= DATE '{SPLIT}')"""


def _num_profile_sql(side: str, name: str) -> str:
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUM)
    return f"""{name}_l AS (UNPIVOT (SELECT {cols} FROM {side}) ON COLUMNS(*) INTO NAME feature VALUE v),
{name} AS (SELECT feature, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS mn, max(v) AS mx,
  count(v) AS cnt FROM {name}_l GROUP BY feature)"""


def _cat_profile_sql(side: str, name: str) -> str:
    cols = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CAT)
    return f"""{name}_l AS (UNPIVOT (SELECT {cols} FROM {side}) ON COLUMNS(*) INTO NAME feature VALUE value),
{name}_c AS (SELECT feature, value, count(*) AS n FROM {name}_l GROUP BY 1, 2),
{name} AS (SELECT feature, value AS top_value, n AS top_count, CAST(total AS BIGINT) AS total, n_values,
  n / total AS top_share FROM (
  SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rk,
    sum(n) OVER (PARTITION BY feature) AS total, count(*) OVER (PARTITION BY feature) AS n_values
  FROM {name}_c) WHERE rk = 1)"""


_BOTH = "SELECT *, 'recent' AS side FROM {0}r UNION ALL SELECT *, 'reference' FROM {0}f"


def _by_side(spark, d):
    a, recent = _split(spark, d)
    return a.withColumn("side", F.when(recent, "recent").otherwise("reference"))


@register("column_profile", f"""WITH {_SIDES}, {_num_profile_sql('rec', 'pr')}, {_num_profile_sql('ref', 'pf')}
SELECT side, feature, {rnd('mean')} AS mean, {rnd('std')} AS std, {rnd('mn')} AS min, {rnd('mx')} AS max,
  cnt AS count FROM ({_BOTH.format('p')})""")
def q_column_profile(spark, d):
    """A12 on both sides of the split, in one pass over all applications."""
    return rounded(P.numeric_profile(_by_side(spark, d), NUM, ["side"]))


@register("category_profile", f"""WITH {_SIDES}, {_cat_profile_sql('rec', 'pr')}, {_cat_profile_sql('ref', 'pf')}
SELECT side, feature, top_value, top_count, total, n_values, {rnd('top_share')} AS top_share FROM ({_BOTH.format('p')})""")
def q_category_profile(spark, d):
    return rounded(P.category_profile(_by_side(spark, d), CAT, ["side"]))


@register("category_shares", f"""WITH {S.SQL_APPLICATIONS}, {_cat_profile_sql('applications', 'p')}
SELECT feature, value, n, {rnd('n / sum(n) OVER (PARTITION BY feature)')} AS share,
  CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS INTEGER) AS rank FROM p_c""")
def q_category_shares(spark, d):
    return rounded(P.category_shares(S.applications(spark, d), CAT))


def details_sql(sides: str) -> str:
    return f"""{sides}, {_num_profile_sql('rec', 'rn')}, {_num_profile_sql('ref', 'fn')},
{_cat_profile_sql('rec', 'rc')}, {_cat_profile_sql('ref', 'fc')},
nd AS (SELECT f.feature, 'numeric' AS comparison_type, f.mean AS avg_reference, r.mean AS avg_recent,
  CASE WHEN abs(f.mean) > 1e-6 THEN abs(r.mean - f.mean) / abs(f.mean) ELSE abs(r.mean - f.mean) END AS change,
  f.std AS ref_std, f.mn AS ref_min, f.mx AS ref_max,
  printf('mean = %.4f', f.mean) AS reference_display, printf('mean = %.4f', r.mean) AS recent_display
  FROM rn r JOIN fn f USING (feature) WHERE r.cnt > 0 AND f.cnt > 0),
cd AS (SELECT f.feature, 'categorical' AS comparison_type, f.top_share AS avg_reference, r.top_share AS avg_recent,
  CASE WHEN r.top_value = f.top_value THEN abs(r.top_share - f.top_share) / greatest(f.top_share, 1e-6)
       ELSE 1.0 END AS change, 0.0 AS ref_std, 0.0 AS ref_min, 0.0 AS ref_max,
  printf('dominant = %s (%.1f%%)', f.top_value, f.top_share * 100) AS reference_display,
  printf('dominant = %s (%.1f%%)', r.top_value, r.top_share * 100) AS recent_display
  FROM rc r JOIN fc f USING (feature)),
details AS (SELECT *, change * 100 AS change_pct,
  CASE WHEN change <= 0.05 THEN 'ok' WHEN change < 0.15 THEN 'low' WHEN change < 0.25 THEN 'medium'
       ELSE 'critical' END AS status_code,
  CAST(list_position({FIELDS_SQL}, feature) AS BIGINT) AS position
  FROM (SELECT * FROM nd UNION ALL SELECT * FROM cd))"""


_DETAILS = details_sql(_SIDES)


def _details(spark, d):
    a, recent_pred = _split(spark, d)
    return D.compare_split(a, recent_pred), a.where(recent_pred)


@register("drift_mixed", f"""WITH {_DETAILS}
SELECT feature, comparison_type, {rnd('avg_reference')} AS avg_reference, {rnd('avg_recent')} AS avg_recent,
  {rnd('change')} AS change, {rnd('change_pct')} AS change_pct, status_code,
  {rnd('ref_std')} AS ref_std, {rnd('ref_min')} AS ref_min, {rnd('ref_max')} AS ref_max, position,
  reference_display, recent_display FROM details""")
def q_drift_mixed(spark, d):
    det, _ = _details(spark, d)
    return rounded(det)


# D3: the log up to LOG_AS_OF against all applications
LOG_AS_OF, LOG_HOURS = "2001-08-02 00:00:00", 24 * 365
LOG_DETAILS = details_sql(f"""{S.SQL_APPLICATIONS},
ref AS (SELECT * FROM applications),
rec AS (SELECT * REPLACE (CASE WHEN NAME_EDUCATION_TYPE <> '{S.BAD_AMOUNTS}' THEN AMT_CREDIT END AS AMT_CREDIT)
  FROM applications WHERE APPLICATION_DATE > TIMESTAMP '{LOG_AS_OF}' - INTERVAL {LOG_HOURS} HOUR
    AND APPLICATION_DATE <= TIMESTAMP '{LOG_AS_OF}')""")


@register("drift_from_log", f"""WITH {LOG_DETAILS}
SELECT feature, comparison_type, {rnd('avg_reference')} AS avg_reference, {rnd('avg_recent')} AS avg_recent,
  {rnd('change')} AS change, status_code, reference_display, recent_display FROM details""")
def q_drift_from_log(spark, d):
    """D3: recent log rows, their payloads and the typed comparison."""
    det, _ = D.detect_drift(S.application_log(spark, d), S.applications(spark, d), LOG_AS_OF, LOG_HOURS)
    return rounded(det.select("feature", "comparison_type", "avg_reference", "avg_recent", "change",
                              "status_code", "reference_display", "recent_display"))


@register("drift_summary", f"""WITH {_DETAILS}
SELECT {rnd('coalesce(avg(change), 0.0)')} AS drift_score, count(*) AS num_features_analyzed,
  coalesce(array_to_string(list_sort(list(feature) FILTER (WHERE status_code <> 'ok')), ','), '') AS affected_features,
  avg(change) > 0.05 AS has_drift, CAST(0.05 AS DOUBLE) AS threshold, (SELECT count(*) FROM rec) AS recent_sample_size
FROM details""")
def q_drift_summary(spark, d):
    det, rec = _details(spark, d)
    s = D.drift_summary(det, rec)
    return rounded(s.withColumn("affected_features", F.array_join("affected_features", ",")))


@register("drift_status_counts", f"""WITH {_DETAILS}
SELECT status_code, count(*) AS n FROM details GROUP BY 1""")
def q_drift_status_counts(spark, d):
    det, _ = _details(spark, d)
    return D.status_counts(det)


@register("drift_top10", f"""WITH {_DETAILS}
SELECT feature, {rnd('change_pct')} AS change_pct, status_code FROM details
ORDER BY CAST(round(CAST(change_pct AS DECIMAL(38, 9)), 6) AS DOUBLE) DESC, feature LIMIT 10""")
def q_drift_top10(spark, d):
    det, _ = _details(spark, d)
    return rounded(D.top_drifting(det, 10).select("feature", "change_pct", "status_code"))


# Numeric columns of the application frame in schema order, IDs excluded
_APP_NUMERIC = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_BIRTH",
                "DAYS_EMPLOYED", "CNT_FAM_MEMBERS", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
                "FLAG_DOCUMENT_2", "FLAG_DOCUMENT_3"]


def _mean_shift_sql() -> str:
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _APP_NUMERIC)
    return f"""{_SIDES},
cl AS (UNPIVOT (SELECT {cols} FROM rec) ON COLUMNS(*) INTO NAME feature VALUE v),
fl AS (UNPIVOT (SELECT {cols} FROM ref) ON COLUMNS(*) INTO NAME feature VALUE v),
c AS (SELECT feature, avg(v) AS current_mean FROM cl GROUP BY 1),
f AS (SELECT feature, avg(v) AS reference_mean FROM fl GROUP BY 1),
m AS (SELECT * FROM c JOIN f USING (feature) WHERE abs(reference_mean) > 1e-6)"""


_MS = _mean_shift_sql()
_VAR = "abs((current_mean - reference_mean) / reference_mean)"


@register("drift_mean_shift", f"""WITH {_MS}
SELECT feature, {rnd('reference_mean')} AS reference_mean, {rnd('current_mean')} AS current_mean,
  {rnd(_VAR)} AS variation_ratio,
  CASE WHEN {_VAR} > 0.5 THEN 'severe' WHEN {_VAR} > 0.3 THEN 'mild' ELSE 'normal' END AS severity
FROM m""")
def q_drift_mean_shift(spark, d):
    """The id column is left out by its name."""
    return rounded(D.mean_shift_split(*_split(spark, d)))


@register("drift_mean_shift_summary", f"""WITH {_MS},
k AS (SELECT count(CASE WHEN {_VAR} > 0.5 THEN 1 END) AS drift_columns_50pct,
             count(CASE WHEN {_VAR} > 0.3 THEN 1 END) AS drift_columns_30pct FROM m)
SELECT (CASE WHEN drift_columns_50pct >= 2 THEN 'severe' WHEN drift_columns_30pct > 6 THEN 'severe'
        WHEN drift_columns_30pct >= 4 THEN 'warning' ELSE 'none' END) = 'severe' AS drift_detected,
  CASE WHEN drift_columns_50pct >= 2 THEN 'severe' WHEN drift_columns_30pct > 6 THEN 'severe'
       WHEN drift_columns_30pct >= 4 THEN 'warning' ELSE 'none' END AS drift_severity,
  drift_columns_30pct, drift_columns_50pct, {len(_APP_NUMERIC)} AS total_monitored FROM k""")
def q_drift_mean_shift_summary(spark, d):
    a, recent = _split(spark, d)
    _, total = D.monitored_numeric(a)
    return D.mean_shift_summary(D.mean_shift_split(a, recent), total)


@register("drift_signed", f"""WITH {_MS}
SELECT feature, {rnd('reference_mean')} AS reference_mean, {rnd('current_mean')} AS current_mean,
  {rnd('(current_mean - reference_mean) / abs(reference_mean) * 100')} AS variation_pct FROM m""")
def q_drift_signed(spark, d):
    return rounded(D.mean_shift_split(*_split(spark, d), signed=True))


@register("payload_drift", f"""WITH {S.SQL_API_LOGS},
p AS (SELECT "timestamp", TRY_CAST(json_extract_string(input_data, 'k') AS DOUBLE) AS k FROM api_logs
      WHERE json_type(input_data) = 'OBJECT'),
r AS (SELECT avg(k) AS m, count(k) AS n FROM p WHERE "timestamp" >= TIMESTAMP '{S.DRIFT_SPLIT}'),
f AS (SELECT avg(k) AS m, count(k) AS n, stddev_samp(k) AS s, min(k) AS mn, max(k) AS mx FROM p
      WHERE "timestamp" < TIMESTAMP '{S.DRIFT_SPLIT}')
SELECT 'k' AS feature, {rnd('f.m')} AS avg_reference, {rnd('r.m')} AS avg_recent,
  {rnd('CASE WHEN abs(f.m) > 1e-6 THEN abs(r.m - f.m) / abs(f.m) ELSE abs(r.m - f.m) END')} AS change,
  {rnd('f.s')} AS ref_std, {rnd('f.mn')} AS ref_min, {rnd('f.mx')} AS ref_max
FROM r, f WHERE r.n > 0 AND f.n > 0""")
def q_payload_drift(spark, d):
    logs = S.api_logs(spark, d)
    frame = payload_frame(logs, "input_data", keep=["timestamp"])
    split = F.lit(S.DRIFT_SPLIT).cast("timestamp_ntz")
    keys = [c for c in frame.columns if c != "timestamp"]
    det = D.compare_split(frame, F.col("timestamp") >= split, fields=keys, numeric=set(keys))
    return rounded(det.select("feature", "avg_reference", "avg_recent", "change",
                              "ref_std", "ref_min", "ref_max"))
