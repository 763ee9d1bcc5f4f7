"""Queries over typed, nested payloads (stand-in: one request for each application)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kredo.functions import payload as PL
from kredo.functions import variant as V
from kredo.plans import standins as S
from kredo.plans.common import register, rnd, rounded


def requests(spark, d):
    """Requests as several clients send them: nested objects, ids as number or text, some
    without an id under its first name, amounts that are no number, an employer only
    for those who have one, and some that are no object at all."""
    a = S.applications(spark, d)
    text = lambda c: F.to_json(F.struct(F.col(c).cast("string").alias("x"))).substr(6, 1000)  # noqa: E731  "..."}
    key = F.col("SK_ID_CURR").cast("string")
    ident = (F.when(F.col("NAME_CONTRACT_STATUS") == "P", F.concat(F.lit('"SK_ID_CURR": 0, "client_id": '), key))
             .when(F.col("CODE_GENDER") == "F", F.concat(F.lit('"SK_ID_CURR": "'), key, F.lit('.0"')))
             .otherwise(F.concat(F.lit('"SK_ID_CURR": '), key)))
    credit = F.when(F.col("NAME_EDUCATION_TYPE") == S.BAD_AMOUNTS, '"hh"').otherwise(F.col("AMT_CREDIT").cast("string"))
    parts = [F.lit("{"), ident, F.lit(', "AMT_CREDIT": '), credit,
             F.lit(', "CODE_GENDER": "'), F.col("CODE_GENDER"), F.lit('", "EXT_SOURCE_1": '),
             F.coalesce(F.col("EXT_SOURCE_1").cast("string"), F.lit("null")),
             F.lit(', "amounts": '), F.to_json(F.struct("AMT_ANNUITY", F.col("CNT_FAM_MEMBERS").alias("members"))),
             F.when(F.col("DAYS_EMPLOYED") != 365000, F.concat(
                 F.lit(', "employer": '), F.to_json(F.struct(F.col("DAYS_EMPLOYED").alias("days"),
                                                             F.struct(F.col("OCCUPATION_TYPE").alias("kind")).alias("work"))))
             ).otherwise(""), F.lit("}")]
    body = F.when(F.col("NAME_HOUSING_TYPE") == "Rented apartment", F.lit("[1, 2]")).otherwise(F.concat(*parts))
    return a.select(F.col("SK_ID_CURR").alias("log_id"), body.alias("input_data"))


_SENT = f"""WITH {S.SQL_APPLICATIONS}, sent AS (SELECT * FROM applications WHERE NAME_HOUSING_TYPE <> 'Rented apartment')"""


@register("variant_payload", f"""{_SENT}
SELECT SK_ID_CURR AS log_id, CASE WHEN SK_ID_CURR <> 0 OR NAME_CONTRACT_STATUS = 'P' THEN SK_ID_CURR END AS client_id,
  CASE WHEN NAME_CONTRACT_STATUS = 'P' THEN '0' WHEN CODE_GENDER = 'F' THEN SK_ID_CURR || '.0' ELSE SK_ID_CURR::VARCHAR END AS sk_id_text,
  {rnd(f"CASE WHEN NAME_EDUCATION_TYPE <> '{S.BAD_AMOUNTS}' THEN AMT_CREDIT END")} AS credit,
  NAME_EDUCATION_TYPE = '{S.BAD_AMOUNTS}' AS bad_credit, CODE_GENDER AS gender, {rnd('EXT_SOURCE_1')} AS ext_source_1,
  {rnd('AMT_ANNUITY')} AS annuity, CAST(CNT_FAM_MEMBERS AS BIGINT) AS members,
  CASE WHEN DAYS_EMPLOYED <> 365000 THEN CAST(DAYS_EMPLOYED AS BIGINT) END AS employer_days,
  CASE WHEN DAYS_EMPLOYED <> 365000 THEN OCCUPATION_TYPE END AS employer_kind FROM sent""")
def q_variant_payload(spark, d):
    """The payloads as typed columns by one schema for all, nested
    objects flattened; fields of several types are text."""
    rows = requests(spark, d).withColumn("client_id", V.client_id(V.parsed("input_data")))
    flat = PL.flatten(V.variant_frame(rows, keep=["log_id", "client_id"]))
    number = F.col("AMT_CREDIT").try_cast("double")
    return rounded(flat.select(
        "log_id", "client_id", F.col("SK_ID_CURR").alias("sk_id_text"), number.alias("credit"),
        (number.isNull() & F.col("AMT_CREDIT").isNotNull()).alias("bad_credit"), F.col("CODE_GENDER").alias("gender"),
        F.col("EXT_SOURCE_1").alias("ext_source_1"), F.col("`amounts.AMT_ANNUITY`").alias("annuity"),
        F.col("`amounts.members`").alias("members"), F.col("`employer.days`").alias("employer_days"),
        F.col("`employer.work.kind`").alias("employer_kind")))


_GROUPS = {"personal": ["CODE_GENDER"], "financial": ["AMT_CREDIT", "amounts"], "work": ["employer"], "external": ["EXT_SOURCE_1"]}


@register("variant_groups", f"""{_SENT}
SELECT SK_ID_CURR AS log_id, 'personal' AS "group", 'CODE_GENDER' AS key, 'STRING' AS kind, CODE_GENDER AS text, NULL::DOUBLE AS number FROM sent
UNION ALL SELECT SK_ID_CURR, 'financial', 'AMT_CREDIT', CASE WHEN NAME_EDUCATION_TYPE = '{S.BAD_AMOUNTS}' THEN 'STRING' ELSE 'NUMBER' END,
  CASE WHEN NAME_EDUCATION_TYPE = '{S.BAD_AMOUNTS}' THEN 'hh' END,
  CASE WHEN NAME_EDUCATION_TYPE <> '{S.BAD_AMOUNTS}' THEN {rnd('AMT_CREDIT')} END FROM sent
UNION ALL SELECT SK_ID_CURR, 'financial', 'amounts', 'OBJECT', NULL, {rnd('AMT_ANNUITY')} FROM sent
UNION ALL SELECT SK_ID_CURR, 'work', 'employer', 'OBJECT', OCCUPATION_TYPE, DAYS_EMPLOYED FROM sent WHERE DAYS_EMPLOYED <> 365000
UNION ALL SELECT SK_ID_CURR, 'external', 'EXT_SOURCE_1', CASE WHEN EXT_SOURCE_1 IS NULL THEN 'VOID' ELSE 'NUMBER' END,
  NULL, {rnd('EXT_SOURCE_1')} FROM sent""")
def q_variant_groups(spark, d):
    """The present keys of each group with their values, nested ones too."""
    rows = V.field_groups(requests(spark, d), groups=_GROUPS).where(F.col("personal").isNotNull())
    long = rows.unpivot(["log_id"], list(_GROUPS), "group", "entries").select(
        "log_id", "group", F.explode("entries").alias("key", "value"))
    kind = F.schema_of_variant("value")
    get = lambda path, t: F.try_variant_get("value", path, t)
    text = F.when(kind == "STRING", get("$", "string")).when(F.col("key") == "employer", get("$.work.kind", "string"))
    number = (F.when(F.col("key") == "amounts", get("$.AMT_ANNUITY", "double")).when(F.col("key") == "employer", get("$.days", "double"))
              .when(kind != "STRING", get("$", "double")))
    short = F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.isin("STRING", "VOID"), kind).otherwise("NUMBER")
    return rounded(long.select("log_id", "group", "key", short.alias("kind"), text.alias("text"), number.alias("number")))


@register("payload_json_text", f"""WITH {S.SQL_APPLICATIONS}
SELECT SK_ID_CURR AS log_id, '{{"CNT_FAM_MEMBERS":' || CNT_FAM_MEMBERS || ',"CODE_GENDER":"' || CODE_GENDER || '","FLAG_DOCUMENT_3":' ||
  coalesce(FLAG_DOCUMENT_3::VARCHAR, 'null') || ',"SHARE":' || CASE WHEN FLAG_DOCUMENT_3 = 1 THEN '0.5' ELSE 'null' END || '}}' AS text,
  CASE WHEN FLAG_DOCUMENT_3 IS NULL THEN 2 WHEN FLAG_DOCUMENT_3 = 1 THEN 0 ELSE 1 END AS n_null FROM applications""")
def q_payload_json_text(spark, d):
    """Rows as JSON text that any reader takes - NaN and missing values as null -
    and read back as VARIANT."""
    from kredo.functions.numeric import nan_to_null
    a = S.applications(spark, d)
    share = F.when(F.col("FLAG_DOCUMENT_3") == 1, F.lit(0.5)).otherwise(F.lit(float("nan")))
    names = ["CNT_FAM_MEMBERS", "CODE_GENDER", "FLAG_DOCUMENT_3", "SHARE"]
    rows = nan_to_null(a.withColumn("SHARE", share)).select(F.col("SK_ID_CURR").alias("log_id"), PL.to_json_text(*names).alias("text"))
    entries = F.try_variant_get(V.parsed("text"), "$", "map<string,variant>")
    nulls = F.size(F.map_filter(entries, lambda _, v: F.is_variant_null(v)))
    return rows.select("log_id", V.json_text(V.parsed("text")).alias("text"), nulls.alias("n_null"))
