"""Queries: per-client aggregates, the joined client table, row features."""

from __future__ import annotations

from pyspark.sql import functions as F

from kredo.functions.features import (create_interaction_features, create_ratio_features,
                                     with_array_row_stats)
from kredo.sources.tables import table
from kredo.operators import aggregates as A
from kredo.operators.joins import join_aggregates, merge_tagged
from kredo.plans import aggregate_sql as Q
from kredo.plans import standins as S
from kredo.plans.common import register, rnd, rounded

SQL_INST_DERIVED = """inst AS (
  SELECT *, AMT_PAYMENT / nullif(AMT_INSTALMENT, 0) AS PAYMENT_PERC,
         AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF,
         DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS DPD
  FROM installments)"""


@register("agg_previous", f"WITH {S.SQL_PREVIOUS} {Q.by_client(Q.PREV, 'previous')}")
def q_agg_previous(spark, d):
    return rounded(A.aggregate_previous(S.previous_applications(spark, d)))


@register("agg_installments", f"WITH {S.SQL_INSTALLMENTS}, {SQL_INST_DERIVED} {Q.by_client(Q.INST, 'inst')}")
def q_agg_installments(spark, d):
    return rounded(A.aggregate_installments(S.installments(spark, d)))


@register("agg_bureau_like", f"WITH {S.SQL_BUREAU} {Q.by_client(Q.BUREAU, 'bureau')}")
def q_agg_bureau(spark, d):
    return rounded(A.aggregate_bureau(S.bureau(spark, d)))


@register("agg_pos_like", f"WITH {S.SQL_POS_CASH} {Q.by_client(Q.POS, 'pos_cash')}")
def q_agg_pos(spark, d):
    return rounded(A.aggregate_pos_cash(S.pos_cash(spark, d)))


@register("agg_card_like", f"WITH {S.SQL_CREDIT_CARD} {Q.by_client(Q.CARD, 'credit_card')}")
def q_agg_card(spark, d):
    return rounded(A.aggregate_credit_card(S.credit_card(spark, d)))


# ------------------------------------------------------------------ flagship
def client_features(spark, d):
    """One row per client: previous-application and instalment aggregates
    left-joined onto the client table, plus the credit/income ratio."""
    base = S.clients(spark, d)
    wide = join_aggregates(base, {"previous": S.previous_applications(spark, d),
                                  "installments": S.installments(spark, d)})
    wide = wide.withColumn("AMT_CREDIT", F.col("prev_AMT_CREDIT_sum"))
    return rounded(create_ratio_features(wide))


CLIENT_FEATURES_SQL = f"""WITH {S.SQL_CLIENTS}, {S.SQL_PREVIOUS}, {S.SQL_INSTALLMENTS}, {SQL_INST_DERIVED},
p AS ({Q.by_client(Q.PREV, 'previous')}),
i AS ({Q.by_client(Q.INST, 'inst')})
SELECT c.*, p.* EXCLUDE (SK_ID_CURR), i.* EXCLUDE (SK_ID_CURR),
  p.prev_AMT_CREDIT_sum AS AMT_CREDIT,
  {rnd("p.prev_AMT_CREDIT_sum / nullif(c.AMT_INCOME_TOTAL + 1, 0)")} AS CREDIT_INCOME_PERC
FROM clients c LEFT JOIN p ON c.SK_ID_CURR = p.SK_ID_CURR LEFT JOIN i ON c.SK_ID_CURR = i.SK_ID_CURR"""


register("client_features", CLIENT_FEATURES_SQL)(client_features)


MERGE_ALL_SQL = f"""WITH {S.SQL_TRAIN_AND_TEST}, {S.SQL_BUREAU}, {S.SQL_PREVIOUS}, {S.SQL_POS_CASH},
{S.SQL_CREDIT_CARD}, {S.SQL_INSTALLMENTS}, {SQL_INST_DERIVED},
b AS ({Q.by_client(Q.BUREAU, 'bureau')}),
p AS ({Q.by_client(Q.PREV, 'previous')}),
o AS ({Q.by_client(Q.POS, 'pos_cash')}),
c AS ({Q.by_client(Q.CARD, 'credit_card')}),
i AS ({Q.by_client(Q.INST, 'inst')})
SELECT * FROM main LEFT JOIN b USING (SK_ID_CURR) LEFT JOIN p USING (SK_ID_CURR)
LEFT JOIN o USING (SK_ID_CURR) LEFT JOIN c USING (SK_ID_CURR) LEFT JOIN i USING (SK_ID_CURR)"""


@register("merge_all", MERGE_ALL_SQL)
def q_merge_all(spark, d):
    """All five side tables (91 outputs) joined once onto train and test."""
    train, test = S.train_and_test(spark, d)
    return rounded(merge_tagged({
        "application_train": train, "application_test": test,
        "bureau": S.bureau(spark, d), "previous": S.previous_applications(spark, d),
        "pos_cash": S.pos_cash(spark, d), "credit_card": S.credit_card(spark, d),
        "installments": S.installments(spark, d)}))


# ------------------------------------------------------------------ row features


@register("ratio_features", f"""WITH {S.SQL_APPLICATIONS}
SELECT SK_ID_CURR,
  {rnd("AMT_CREDIT / nullif(AMT_INCOME_TOTAL + 1, 0)")} AS CREDIT_INCOME_PERC,
  {rnd("AMT_ANNUITY / nullif(AMT_CREDIT + 1, 0)")} AS ANNUITY_CREDIT_PERC,
  {rnd("AMT_GOODS_PRICE / nullif(AMT_CREDIT + 1, 0)")} AS GOODS_CREDIT_PERC,
  {rnd("AMT_ANNUITY / nullif(AMT_INCOME_TOTAL + 1, 0)")} AS ANNUITY_INCOME_PERC,
  {rnd("-DAYS_BIRTH / 365.25")} AS AGE_YEARS,
  {rnd("CASE WHEN -DAYS_EMPLOYED / 365.25 < 0 THEN 0.0 ELSE -DAYS_EMPLOYED / 365.25 END")} AS EMPLOYED_YEARS
FROM applications""")
def q_ratio_features(spark, d):
    df = create_ratio_features(S.applications(spark, d))
    return rounded(df.select("SK_ID_CURR", "CREDIT_INCOME_PERC", "ANNUITY_CREDIT_PERC",
                             "GOODS_CREDIT_PERC", "ANNUITY_INCOME_PERC", "AGE_YEARS",
                             "EMPLOYED_YEARS"))


@register("interaction_features", f"""WITH {S.SQL_APPLICATIONS}
SELECT SK_ID_CURR,
  {rnd("AMT_INCOME_TOTAL / nullif(CNT_FAM_MEMBERS + 1, 0)")} AS INCOME_PER_PERSON,
  {rnd("AMT_CREDIT / nullif(CNT_FAM_MEMBERS + 1, 0)")} AS CREDIT_PER_PERSON
FROM applications""")
def q_interaction_features(spark, d):
    df = create_interaction_features(S.applications(spark, d))
    return rounded(df.select("SK_ID_CURR", "INCOME_PER_PERSON", "CREDIT_PER_PERSON"))


@register("ext_source_stats", f"""WITH {S.SQL_APPLICATIONS},
v AS (SELECT SK_ID_CURR, list_filter([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3], lambda x: x IS NOT NULL) AS xs
      FROM applications)
SELECT SK_ID_CURR,
  {rnd("list_avg(xs)")} AS EXT_SOURCES_MEAN,
  {rnd("CASE WHEN len(xs) >= 2 THEN list_stddev_samp(xs) END")} AS EXT_SOURCES_STD,
  {rnd("list_max(xs)")} AS EXT_SOURCES_MAX,
  {rnd("list_min(xs)")} AS EXT_SOURCES_MIN
FROM v""")
def q_ext_source_stats(spark, d):
    df = create_ratio_features(S.applications(spark, d))
    return rounded(df.select("SK_ID_CURR", "EXT_SOURCES_MEAN", "EXT_SOURCES_STD",
                             "EXT_SOURCES_MAX", "EXT_SOURCES_MIN"))


@register("document_count", f"""WITH {S.SQL_APPLICATIONS}
SELECT SK_ID_CURR, coalesce(FLAG_DOCUMENT_2, 0) + coalesce(FLAG_DOCUMENT_3, 0) AS DOCUMENT_COUNT
FROM applications""")
def q_document_count(spark, d):
    df = create_ratio_features(S.applications(spark, d))
    return df.select("SK_ID_CURR", "DOCUMENT_COUNT")


@register("embedding_row_stats", f"""SELECT vec_id,
  {rnd("list_avg(list_filter(embedding, lambda x: x IS NOT NULL))")} AS EMB_MEAN,
  {rnd("CASE WHEN len(list_filter(embedding, lambda x: x IS NOT NULL)) >= 2 THEN list_stddev_samp(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) END")} AS EMB_STD,
  {rnd("list_max(embedding)")} AS EMB_MAX, {rnd("list_min(embedding)")} AS EMB_MIN
FROM embeddings""")
def q_embedding_row_stats(spark, d):
    """F7 on whole embedding vectors (64 values per row)."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    out = with_array_row_stats(e, "embedding", "EMB")
    return rounded(out.select("vec_id", "EMB_MEAN", "EMB_STD", "EMB_MAX", "EMB_MIN"))
