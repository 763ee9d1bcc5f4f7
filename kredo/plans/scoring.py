"""Queries: model scoring (stand-in: documents with labels)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from kredo.operators import scoring as SC
from kredo.plans.common import register, rnd, rounded
from kredo.sources.files import read_json_array
from kredo.sources.sinks import export_json
from kredo.sources.tables import table
from kredo.streaming.monitor import work_dir

NUMERIC = ["n_chars", "n_words"]
CATEGORICAL = ["lang", "source"]
BATCH = 20
SAMPLES = 500            # documents of one file of samples


def _training(spark, d):
    doc = table(spark, d, "documents").select(
        "doc_id", "n_chars", "lang", "source",
        F.size(F.split(F.col("text"), r"\s+")).cast("double").alias("n_words"))
    lab = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    return doc, doc.join(lab, "doc_id", "inner")


def _model(spark, d, kind="logistic"):
    """The document model: fitted once per session and data folder, then
    loaded from the model store by every scoring query."""
    docs, train = _training(spark, d)
    return docs, SC.fit_or_load(train, NUMERIC, CATEGORICAL, key=f"documents:{d}",
                                label="label", model=kind)


def q_batch_score(spark, d):
    docs, model = _model(spark, d)
    return SC.predict_proba(docs, model, NUMERIC, CATEGORICAL).select("doc_id", "score")


def q_feature_importance(spark, d):
    _, model = _model(spark, d, "gbt")
    names = SC.feature_names(model, NUMERIC, CATEGORICAL)
    return SC.feature_importance(spark, model, names, top_n=20)


def q_contributions(spark, d):
    docs, model = _model(spark, d)
    return SC.linear_contributions(docs, model, NUMERIC, CATEGORICAL, "doc_id", top_k=10)


# rows-only queries (fitted models have no SQL twin)
register("batch_score")(q_batch_score)
register("feature_importance")(q_feature_importance)
register("contributions")(q_contributions)

# Fixed coefficients of a document model, for queries that SQL can follow.
INTERCEPT = -1.0
WEIGHTS = {"n_chars": 0.0005, "n_words": -0.002}
LANG_WEIGHTS = {"en": 0.25, "de": -0.5, "fr": 0.125}
# texts below so many characters carry an n_chars that is no number
SHORT = 200


def scorecard():
    return SC.fixed_pipeline(INTERCEPT, WEIGHTS, {"lang": LANG_WEIGHTS})


def document_features(docs):
    return docs.select("doc_id", "n_chars", "lang", "source",
                       F.size(F.split(F.col("text"), r"\s+")).cast("double").alias("n_words"))


def request_item():
    """The JSON request of one document, all values as text."""
    return F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("client_id"),
        F.when(F.col("n_chars") < SHORT, "hh").otherwise(F.col("n_chars").cast("string")).alias("n_chars"),
        F.col("n_words").cast("string").alias("n_words"), "lang", "source"))


# n_words as Spark's split on white space counts it
_LANG = " ".join(f"WHEN '{v}' THEN {w}" for v, w in LANG_WEIGHTS.items())
DOC_FEATURES_SQL = f"""f AS (SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars,
  CAST(len(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS DOUBLE) AS n_words FROM documents)"""
_LOGIT = (f"{INTERCEPT} + {WEIGHTS['n_chars']} * n_chars + {WEIGHTS['n_words']} * n_words "
          f"+ CASE lang {_LANG} ELSE 0 END")
_SCORE = f"1.0 / (1.0 + exp(-({_LOGIT})))"
SCORED_REQUESTS_SQL = f"""WITH {DOC_FEATURES_SQL}
SELECT {{request}}, CAST({{item}} AS INTEGER) AS item_no, '{{kind}}' AS prediction_type, doc_id AS client_id,
  CASE WHEN n_chars >= {SHORT} THEN {rnd(_SCORE)} END AS score,
  CASE WHEN n_chars < {SHORT} THEN 'rejected: n_chars' END AS error_message FROM f"""


@register("request_scoring", SCORED_REQUESTS_SQL.format(
    request=f"doc_id // {BATCH} AS request_id", kind="batch",
    item=f"row_number() OVER (PARTITION BY doc_id // {BATCH} ORDER BY doc_id) - 1"))
def q_request_scoring(spark, d):
    """Requests built from the documents table: consecutive documents form
    batches of at most BATCH items (so no request array grows with the
    data), in the order of their ids; short texts carry an invalid n_chars."""
    docs = document_features(table(spark, d, "documents"))
    items = F.array_sort(F.collect_list(F.struct("doc_id", request_item().alias("item"))))
    req = docs.groupBy(F.floor(F.col("doc_id") / BATCH).alias("request_id")).agg(
        F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["item"]), ","), F.lit("]")).alias("data"))
    scored = SC.score_requests(req, scorecard(), NUMERIC, CATEGORICAL, "data", id_cols=["request_id"])
    return rounded(scored.select("request_id", "item_no", "prediction_type", "client_id", "score", "error_message"))


_TERMS = {**WEIGHTS, **{f"lang={v}": w for v, w in LANG_WEIGHTS.items()}}


def _input_sql(name: str) -> str:
    return f"CAST(lang = '{name[5:]}' AS INTEGER)::DOUBLE" if name.startswith("lang=") else name


@register("fixed_contributions", f"""WITH {DOC_FEATURES_SQL},
t AS ({" UNION ALL ".join(f"SELECT doc_id, '{n}' AS feature, {_input_sql(n)} AS value, {w} * ({_input_sql(n)} - avg({_input_sql(n)}) OVER ()) AS contribution FROM f" for n, w in _TERMS.items())}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(contribution) DESC, feature DESC) AS rank FROM t)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, feature, {rnd('value')} AS value, {rnd('contribution')} AS contribution
FROM r WHERE rank <= 3""")
def q_fixed_contributions(spark, d):
    """M5 with given coefficients: the three strongest terms of every document."""
    docs = document_features(table(spark, d, "documents"))
    inputs = [F.col(n).cast("double") for n in WEIGHTS] + [(F.col("lang") == v).cast("double") for v in LANG_WEIGHTS]
    return rounded(SC.contributions(docs.withColumn("x", F.array(*inputs)), "x", list(_TERMS), list(_TERMS.values()),
                                    "doc_id", top_k=3))


# Fixed parameters of the external scorecard (stand-in for a shipped model).
SCORECARD_INTERCEPT = -4.0
SCORECARD_WEIGHTS = {"n_chars": 0.45}


@register("external_model_score", f"""SELECT doc_id,
  {rnd(f"1.0 / (1.0 + exp(-({SCORECARD_INTERCEPT} + {SCORECARD_WEIGHTS['n_chars']} * ln(1 + CAST(n_chars AS DOUBLE)))))")} AS score
FROM documents""")
def q_external_model_score(spark, d):
    """M1 with an external Python model: Arrow batches via mapInPandas, the
    model broadcast once."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    model = SC.LogisticScorecard(SCORECARD_INTERCEPT, list(SCORECARD_WEIGHTS.values()))
    scored = SC.score_with_python_model(docs, model, list(SCORECARD_WEIGHTS))
    return rounded(scored.select("doc_id", "score"))


def _inputs(spark, d):
    docs = document_features(table(spark, d, "documents"))
    inputs = [F.col(n).cast("double") for n in WEIGHTS] + [(F.col("lang") == v).cast("double") for v in LANG_WEIGHTS]
    return docs.withColumn("x", F.array(*inputs))


@register("importance_export", f"""WITH {DOC_FEATURES_SQL},
i AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, abs({w}) * stddev_pop({_input_sql(n)}) AS importance FROM f" for n, w in _TERMS.items())}),
t AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rk FROM i)
SELECT feature, {rnd('importance / sum(importance) OVER ()')} AS importance FROM t WHERE rk <= 4""")
def q_importance_export(spark, d):
    """The four strongest inputs of the scorecard, normalised, exported
    as JSON lines and read back."""
    top = SC.standardised_importance(_inputs(spark, d), "x", list(_TERMS), list(_TERMS.values()), top_n=4)
    path = os.path.join(work_dir(spark, "importance"), "importance.json")
    export_json(SC.normalised_importance(top), path)
    return rounded(spark.read.schema("feature string, importance double").json(path))


@register("json_array_samples", f"""WITH {DOC_FEATURES_SQL}
SELECT 'document ' || doc_id AS description, doc_id AS client_id, {rnd('n_chars')} AS n_chars, {rnd('n_words')} AS n_words, lang, source FROM f""")
def q_json_array_samples(spark, d):
    """Samples as files that each hold a JSON array of {description, data}, the
    ``data`` fields as columns."""
    docs = document_features(table(spark, d, "documents"))
    item = F.to_json(F.struct(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("description"), F.struct(
        F.col("doc_id").alias("client_id"), F.col("n_chars").cast("double").alias("n_chars"), "n_words", "lang", "source").alias("data")))
    files = docs.groupBy(F.floor(F.col("doc_id") / SAMPLES).alias("f")).agg(F.collect_list(item).alias("items"))
    path = os.path.join(work_dir(spark, "samples"), "samples")
    files.select(F.concat(F.lit("["), F.array_join("items", ",\n"), F.lit("]"))).write.option("maxRecordsPerFile", 1).text(path)
    return rounded(read_json_array(spark, path).select("description", "client_id", "n_chars", "n_words", "lang", "source"))
