"""Queries: scaling, encoding, alignment, validation, domain rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from kredo.operators import encoding as E
from kredo.operators import scaling as SC
from kredo.plans import standins as S
from kredo.plans.common import register, rnd, rounded
from kredo.sources.tables import table

SCALE_COLS = ["p_size", "p_retailprice"]


def _scale_sql(method: str) -> str:
    stats = ", ".join(
        f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}, "
        f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in SCALE_COLS)
    if method == "standard":
        items = ", ".join(
            rnd(f"(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN coalesce(s_{c}, 0) = 0 THEN 1 ELSE s_{c} END")
            + f" AS {c}" for c in SCALE_COLS)
    else:
        items = ", ".join(
            rnd(f"(CAST({c} AS DOUBLE) - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END")
            + f" AS {c}" for c in SCALE_COLS)
    return f"WITH s AS (SELECT {stats} FROM part)\nSELECT p_partkey, {items} FROM part, s"


def _scale(spark, d, method):
    part = table(spark, d, "part")
    train, _, _ = SC.scale_features(part.select("p_partkey", *SCALE_COLS), method=method,
                                    cols=SCALE_COLS)
    return rounded(train)


@register("standard_scale", _scale_sql("standard"))
def q_standard_scale(spark, d):
    return _scale(spark, d, "standard")


@register("minmax_scale", _scale_sql("minmax"))
def q_minmax_scale(spark, d):
    return _scale(spark, d, "minmax")


@register("scale_checks", """WITH p AS (SELECT count(*) AS n, count(CASE WHEN p_size <= 40 THEN 1 END) AS m FROM part)
SELECT 'complete' AS "case", false AS refused FROM p UNION ALL SELECT 'missing values', m < n FROM p
UNION ALL SELECT 'unknown method', n > 0 FROM p UNION ALL SELECT 'constant', false FROM p""")
def q_scale_checks(spark, d):
    """What the scaler refuses - columns with missing values and methods that
    it doesn't know - and what it takes."""
    part = table(spark, d, "part").select("p_partkey", *SCALE_COLS)
    some = part.withColumn("p_size", F.when(F.col("p_size") <= 40, F.col("p_size")))
    cases = [("complete", part, "standard"), ("missing values", some, "standard"), ("unknown method", part, "robust"),
             ("constant", part.withColumn("p_size", F.lit(7)), "minmax")]
    found = []
    for name, rows, method in cases:
        try:
            SC.scale_features(rows, method=method, cols=SCALE_COLS)
            found.append((name, False))
        except ValueError:
            found.append((name, True))
    return spark.createDataFrame(found, "case string, refused boolean")


ENC_COLS = ["NAME_CONTRACT_STATUS", "OCCUPATION_TYPE", "NAME_TYPE_SUITE"]


def _enc_input(spark, d):
    a = S.applications(spark, d)
    return a.select("SK_ID_CURR", "NAME_CONTRACT_STATUS", "OCCUPATION_TYPE", "FLAG_OWN_CAR",
                    F.when(F.col("NAME_CONTRACT_STATUS") != "P", F.col("NAME_EDUCATION_TYPE"))
                    .alias("NAME_TYPE_SUITE"))


_ENC_CTE = f"""{S.SQL_APPLICATIONS},
x AS (SELECT SK_ID_CURR, NAME_CONTRACT_STATUS, OCCUPATION_TYPE, FLAG_OWN_CAR,
  CASE WHEN NAME_CONTRACT_STATUS <> 'P' THEN NAME_EDUCATION_TYPE END AS NAME_TYPE_SUITE FROM applications)"""


def _codes_sql(c: str) -> str:
    return (f"k_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM "
            f"(SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), '__MISSING__') AS v FROM x))")


@register("encode_labels", f"""WITH {_ENC_CTE}, {", ".join(_codes_sql(c) for c in ENC_COLS)}
SELECT x.SK_ID_CURR, CASE WHEN x.FLAG_OWN_CAR = 'Y' THEN 1 ELSE 0 END AS FLAG_OWN_CAR,
  {", ".join(f"k_{c}.code AS {c}_enc" for c in ENC_COLS)}
FROM x {" ".join(f"LEFT JOIN k_{c} ON coalesce(CAST(x.{c} AS VARCHAR), '__MISSING__') = k_{c}.v" for c in ENC_COLS)}""")
def q_encode_labels(spark, d):
    x = _enc_input(spark, d)
    codes = E.fit_codes(x, ENC_COLS)
    out = E.encode_labels(x, ENC_COLS, codes).withColumn("FLAG_OWN_CAR", E.yes_no_to_int("FLAG_OWN_CAR"))
    return out.withColumns({f"{c}_enc": F.col(f"{c}_enc").cast("int") for c in ENC_COLS})


# Generator domains of the stand-in columns (fixed by the test tables).
ONE_HOT_VOCAB = {
    "OCCUPATION_TYPE": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "NAME_EDUCATION_TYPE": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}


@register("one_hot_encode", f"""WITH {S.SQL_APPLICATIONS}
SELECT SK_ID_CURR, AMT_CREDIT, {", ".join(
    f"CAST(coalesce(CAST({c} AS VARCHAR), '__MISSING__') = '{v}' AS INTEGER) AS {c}_enc_{i}"
    for c, vs in ONE_HOT_VOCAB.items() for i, v in enumerate(vs))}
FROM applications""")
def q_one_hot_encode(spark, d):
    a = S.applications(spark, d).select("SK_ID_CURR", "AMT_CREDIT", *ONE_HOT_VOCAB)
    vocab = E.vocabulary(E.fit_codes(a, list(ONE_HOT_VOCAB)))
    return rounded(E.one_hot(a, vocab))


EXPECTED = ["SK_ID_CURR", "AMT_INCOME_TOTAL", "AMT_CREDIT", "CNT_CHILDREN", "EXT_SOURCE_2", "DAYS_BIRTH"]


@register("align_columns", f"""WITH {S.SQL_APPLICATIONS}
SELECT SK_ID_CURR, {rnd('AMT_INCOME_TOTAL')} AS AMT_INCOME_TOTAL, {rnd('AMT_CREDIT')} AS AMT_CREDIT,
  CAST(0.0 AS DOUBLE) AS CNT_CHILDREN, {rnd('EXT_SOURCE_2')} AS EXT_SOURCE_2, DAYS_BIRTH
FROM applications""")
def q_align_columns(spark, d):
    num = E.numeric_projection(S.applications(spark, d))
    return rounded(E.align_columns(num, EXPECTED))


def _requests(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("log_id"),
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_type") == "error", F.lit("hh"))
         .otherwise(F.col("value").cast("string")).alias("AMT_INCOME_TOTAL"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("string"))
         .otherwise(F.col("user_id").cast("string")).alias("CNT_CHILDREN"))


@register("validate_numeric", """WITH r AS (
  SELECT event_id AS log_id, json_extract_string(props, '$.k') AS k,
    CASE WHEN event_type = 'error' THEN 'hh' ELSE CAST(value AS VARCHAR) END AS AMT_INCOME_TOTAL,
    CASE WHEN event_type = 'view' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS CNT_CHILDREN FROM events)
SELECT log_id, array_to_string(list_filter([
    CASE WHEN k IS NOT NULL AND TRY_CAST(k AS DOUBLE) IS NULL THEN 'k' END,
    CASE WHEN AMT_INCOME_TOTAL IS NOT NULL AND TRY_CAST(AMT_INCOME_TOTAL AS DOUBLE) IS NULL THEN 'AMT_INCOME_TOTAL' END,
    CASE WHEN CNT_CHILDREN IS NOT NULL AND TRY_CAST(CNT_CHILDREN AS DOUBLE) IS NULL THEN 'CNT_CHILDREN' END],
    lambda x: x IS NOT NULL), ',') AS rejected_fields
FROM r""")
def q_validate_numeric(spark, d):
    r = _requests(spark, d)
    bad = E.invalid_numeric_fields(["k", "AMT_INCOME_TOTAL", "CNT_CHILDREN"])
    return r.select("log_id", F.array_join(bad, ",").alias("rejected_fields"))


def _in(col, values):
    return f"{col} IN (" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_RULES_SQL = {
    "gender_allowed": ("CODE_GENDER", _in("CODE_GENDER", E.GENDERS)),
    "own_car_yn": ("FLAG_OWN_CAR", _in("FLAG_OWN_CAR", E.YES_NO)),
    "own_realty_yn": ("FLAG_OWN_REALTY", _in("FLAG_OWN_REALTY", E.YES_NO)),
    "family_allowed": ("NAME_FAMILY_STATUS", _in("NAME_FAMILY_STATUS", E.FAMILY_STATUSES)),
    "housing_allowed": ("NAME_HOUSING_TYPE", _in("NAME_HOUSING_TYPE", E.HOUSING_TYPES)),
    "education_allowed": ("NAME_EDUCATION_TYPE", _in("NAME_EDUCATION_TYPE", E.EDUCATION_TYPES)),
    "occupation_allowed": ("OCCUPATION_TYPE", _in("OCCUPATION_TYPE", E.OCCUPATION_TYPES)),
    "family_at_least_1": ("CNT_FAM_MEMBERS", "CNT_FAM_MEMBERS >= 1"),
    "income_non_negative": ("AMT_INCOME_TOTAL", "AMT_INCOME_TOTAL >= 0"),
    "credit_non_negative": ("AMT_CREDIT", "AMT_CREDIT >= 0"),
    "annuity_non_negative": ("AMT_ANNUITY", "AMT_ANNUITY >= 0"),
    "goods_non_negative": ("AMT_GOODS_PRICE", "AMT_GOODS_PRICE >= 0"),
    "ext1_unit": ("EXT_SOURCE_1", "EXT_SOURCE_1 BETWEEN 0 AND 1"),
    "ext2_unit": ("EXT_SOURCE_2", "EXT_SOURCE_2 BETWEEN 0 AND 1"),
    "ext3_unit": ("EXT_SOURCE_3", "EXT_SOURCE_3 BETWEEN 0 AND 1"),
    "birth_in_past": ("DAYS_BIRTH", "DAYS_BIRTH < 0"),
    "employed_in_past": ("DAYS_EMPLOYED", "DAYS_EMPLOYED < 0 OR DAYS_EMPLOYED = 365000"),
}


@register("domain_violations", f"""WITH {S.SQL_APPLICATIONS}
{" UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(CASE WHEN {c} IS NOT NULL AND NOT ({p}) THEN 1 END) AS violations FROM applications"
    for n, (c, p) in _RULES_SQL.items())}""")
def q_domain_violations(spark, d):
    return E.violation_counts(S.applications(spark, d))
