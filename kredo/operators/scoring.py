"""Scoring (M1-M5) with Spark ML.

The reference ships no model artifact, so models are Spark ML pipelines
fitted on a table (distributed L-BFGS / tree learners).  Scoring is
``PipelineModel.transform`` - JVM-side, one projection per row - and the
probability of class 1 is read with ``vector_to_array``.  An external Python
model with ``predict_proba`` is scored batch-wise with ``mapInPandas`` (Arrow
batches, model shipped once per executor via a broadcast variable).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kredo.operators.encoding import MISSING


def build_pipeline(numeric: list[str], categorical: list[str], label: str = "label",
                   model: str = "logistic", max_iter: int = 50) -> Pipeline:
    """Encode categoricals (missing -> __MISSING__, unseen kept), assemble,
    scale, classify."""
    idx = [StringIndexer(inputCol=f"{c}__s", outputCol=f"{c}__i", handleInvalid="keep")
           for c in categorical]
    ohe = [OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__v", handleInvalid="keep")
           for c in categorical]
    asm = VectorAssembler(inputCols=numeric + [f"{c}__v" for c in categorical],
                          outputCol="features", handleInvalid="keep")
    if model == "logistic":
        # standardises internally and reports coefficients on the original
        # scale, so no separate scaler pass is needed
        clf = LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter,
                                 standardization=True)
    elif model == "gbt":
        # node ids cached and checkpointed to the shared folder every 10
        # trees, so the lineage of the boosting loop stays short
        clf = GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter,
                            seed=42, cacheNodeIds=True, checkpointInterval=10)
    else:
        raise ValueError(f"unknown model {model!r}")
    return Pipeline(stages=[*idx, *ohe, asm, clf])


def prepare(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Columns in the form the pipeline expects (absent numeric -> 0.0,
    missing category -> __MISSING__)."""
    have = set(df.columns)
    cols = {c: (F.col(c).cast("double") if c in have else F.lit(0.0)) for c in numeric}
    cols.update({f"{c}__s": F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) if c in have
                 else F.lit(MISSING) for c in categorical})
    return df.withColumns(cols)


def fit(df: DataFrame, numeric: list[str], categorical: list[str], label: str = "label",
        model: str = "logistic", max_iter: int | None = None) -> PipelineModel:
    """Fit the pipeline.  Its stages make several passes (indexers, scaler,
    then the iterative learner), so the prepared training frame is persisted
    (memory and disk; recomputed from lineage if an executor is lost) for the
    duration of the fit only."""
    from pyspark import StorageLevel
    prepared = prepare(df, numeric, categorical).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        steps = max_iter or (20 if model == "gbt" else 50)
        return build_pipeline(numeric, categorical, label, model, steps).fit(prepared)
    finally:
        prepared.unpersist()


def data_version(df: DataFrame) -> str:
    """A digest of the files that a frame reads: path, length and time of change."""
    import hashlib
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    lines = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        lines.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:16]


def fit_or_load(df: DataFrame, numeric: list[str], categorical: list[str], key: str,
                label: str = "label", model: str = "logistic", version: str | None = None) -> PipelineModel:
    """Model artifact store: the pipeline saved for ``key`` and ``version`` in the
    session's shared checkpoint folder, or one fitted on ``df`` and saved.

    ``version`` is by default that of the data, so changed files are never scored
    with the model of the old ones.  An artifact that cannot be read raises."""
    import hashlib
    import os

    from kredo.session import checkpoint_dir
    from kredo.sources.files import _exists
    spark = df.sparkSession
    version = data_version(df) if version is None else version
    digest = hashlib.sha1("|".join([key, version, model, label, *numeric, "/", *categorical])
                          .encode()).hexdigest()[:16]
    path = os.path.join(checkpoint_dir(spark), "models", digest)
    if path in _LOADED:                 # already in this driver process
        return _LOADED[path]
    # a model is saved under a name of its own and renamed, so one that is there is whole
    if _exists(spark, path):
        fitted = PipelineModel.load(path)
    else:
        fitted = fit(df, numeric, categorical, label, model)
        _publish(spark, fitted, path)
    _LOADED[path] = fitted
    return fitted


def _publish(spark, fitted: PipelineModel, path: str) -> None:
    """Save and rename; where another writer was first, its model stays."""
    import uuid

    from kredo.sources.files import _exists
    own = f"{path}-{uuid.uuid4().hex}"
    fitted.write().save(own)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not _exists(spark, path) and not fs.rename(Path(own), Path(path)) and not _exists(spark, path):
        raise OSError(f"cannot save the model at {path}")


_LOADED: dict[str, PipelineModel] = {}


def predict_proba(df: DataFrame, model: PipelineModel, numeric: list[str],
                  categorical: list[str], out: str = "score") -> DataFrame:
    """M1: probability of class 1 as a double column."""
    scored = model.transform(prepare(df, numeric, categorical))
    keep = [c for c in df.columns]
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def feature_names(model: PipelineModel, numeric: list[str], categorical: list[str]) -> list[str]:
    names = list(numeric)
    for stage in model.stages:
        if hasattr(stage, "labelsArray") and stage.getOutputCol().endswith("__i"):
            col = stage.getOutputCol()[:-3]
            labels = stage.labelsArray[0]
            # handleInvalid=keep gives unseen values a slot after the labels
            names += [f"{col}={v}" for v in labels] + [f"{col}=(other)"]
    return names


def feature_importance(spark, model: PipelineModel, names: list[str], top_n: int = 20) -> DataFrame:
    """M4: |coefficient| (linear) or impurity importance (trees), top N."""
    clf = model.stages[-1]
    if hasattr(clf, "featureImportances"):
        values = clf.featureImportances.toArray().tolist()
    elif hasattr(clf, "coefficients"):
        values = [abs(v) for v in clf.coefficients.toArray().tolist()]
    else:
        raise TypeError("model has neither feature importances nor coefficients")
    if len(values) != len(names):
        raise ValueError(f"the model has {len(values)} inputs and {len(names)} names were given")
    rows = [(name, float(value)) for name, value in zip(names, values)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top_n)


def standardised_importance(df: DataFrame, inputs: str, names: list[str], coefficients: list[float],
                            top_n: int | None = 20) -> DataFrame:
    """M4 (linear models): |coefficient| times the standard deviation of its input, so
    that inputs of different scales compare; one aggregate over the array of inputs."""
    if len(names) != len(coefficients):
        raise ValueError(f"the model has {len(coefficients)} inputs and {len(names)} names were given")
    spread = df.agg(*[F.stddev_pop(F.col(inputs)[j]).alias(str(j)) for j in range(len(names))])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), (F.abs(F.lit(float(c))) * F.col(str(j))).alias("importance"))
                     for j, (n, c) in enumerate(zip(names, coefficients))])
    found = spread.select(F.explode(rows).alias("r")).select("r.*")
    found = found.orderBy(F.col("importance").desc_nulls_last(), F.col("feature"))
    return found.limit(top_n) if top_n else found


def normalised_importance(imp: DataFrame) -> DataFrame:
    """M6: importances summing to 1; NaN and missing ones are 0."""
    clean = imp.withColumn("importance", F.coalesce(F.nanvl("importance", F.lit(0.0)), F.lit(0.0)))
    total = clean.agg(F.sum("importance")).scalar()
    return clean.withColumn("importance", F.coalesce(F.try_divide(F.col("importance"), total), F.lit(0.0)))


def linear_contributions(df: DataFrame, model: PipelineModel, numeric: list[str], categorical: list[str],
                         id_col: str, top_k: int | None = 10) -> DataFrame:
    """M5 (linear models): ``contributions`` over all inputs of the model, those of
    the categories included, named as in ``feature_names``."""
    prepared = prepare(df, numeric, categorical)
    for stage in model.stages[:-1]:
        prepared = stage.transform(prepared)
    return contributions(prepared.withColumn("_x", vector_to_array("features")), "_x",
                         feature_names(model, numeric, categorical),
                         model.stages[-1].coefficients.toArray().tolist(), id_col, top_k)


def contributions(df: DataFrame, inputs: str, names: list[str], coefficients: list[float],
                  id_col: str, top_k: int | None = 10) -> DataFrame:
    """(id, rank, feature, value, contribution): contribution_j = coef_j * (x_j -
    mean_j) over an array column of model inputs; the ``top_k`` by |contribution| of
    each row (all with None), ties by name from the last.  One aggregate gives the
    means; ranking is a sort and a slice inside the row: no shuffle, no window."""
    if len(names) != len(coefficients):
        raise ValueError(f"the model has {len(coefficients)} inputs and {len(names)} names were given")
    means = df.agg(*[F.avg(F.col(inputs)[j]).alias(str(j)) for j in range(len(names))]).first()
    terms = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(float(c)).alias("coef"), F.lit(float(means[j] or 0.0)).alias("mean"))
                      for j, (n, c) in enumerate(zip(names, coefficients))])

    def term(t, x):
        value = t["coef"] * (F.coalesce(x, F.lit(0.0)) - t["mean"])
        return F.struct(F.abs(value).alias("size"), t["feature"].alias("feature"), x.alias("value"),
                        value.alias("contribution"))
    ranked = F.sort_array(F.zip_with(terms, inputs, term), asc=False)
    if top_k is not None:
        ranked = F.slice(ranked, 1, top_k)
    return (df.select(id_col, F.posexplode(ranked).alias("pos", "c"))
            .select(id_col, (F.col("pos") + 1).alias("rank"), "c.feature", "c.value", "c.contribution"))


def fixed_pipeline(intercept: float, weights: dict[str, float],
                   categories: dict[str, dict[str, float]] | None = None) -> PipelineModel:
    """A logistic model of given coefficients as a pipeline: numeric ``weights`` and,
    for each category column, the weight of its values (others 0)."""
    terms = [repr(float(intercept)), *[f"{float(w)!r}D * coalesce({c}, 0D)" for c, w in weights.items()]]
    for c, values in (categories or {}).items():
        cases = " ".join(f"WHEN '{_quoted(v)}' THEN {float(w)!r}D" for v, w in values.items())
        terms.append(f"CASE {c}__s {cases} ELSE 0D END")
    score = SQLTransformer(statement=f"SELECT *, 1D / (1D + exp(-({' + '.join(terms)}))) AS _p FROM __THIS__")
    both = SQLTransformer(statement="SELECT *, 1D - _p AS _q FROM __THIS__")
    return PipelineModel([score, both, VectorAssembler(inputCols=["_q", "_p"], outputCol="probability",
                                                       handleInvalid="keep")])


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


class LogisticScorecard:
    """A small external model with ``predict_proba`` (numpy): logistic of an
    intercept plus weights on log1p-transformed features.  Stands for any
    model object scored through ``score_with_python_model``."""

    def __init__(self, intercept: float, weights: list[float]):
        self.intercept = float(intercept)
        self.weights = np.asarray(weights, dtype="float64")

    def predict_proba(self, x):
        z = self.intercept + np.log1p(np.asarray(x, dtype="float64")) @ self.weights
        p = 1.0 / (1.0 + np.exp(-z))
        return np.column_stack([1.0 - p, p])


def score_with_python_model(df: DataFrame, model, feature_cols: list[str], out: str = "score") -> DataFrame:
    """M1 for an external model object with ``predict_proba`` (Arrow batches)."""
    from kredo.session import ship_package
    ship_package(df.sparkSession)
    sc = df.sparkSession.sparkContext
    bmodel = sc.broadcast(model)
    schema = StructType(df.schema.fields + [StructField(out, DoubleType())])

    def run(batches):
        m = bmodel.value
        for pdf in batches:
            x = pdf[feature_cols].astype("float64").fillna(0.0).to_numpy()
            pdf[out] = m.predict_proba(x)[:, 1] if len(pdf) else []
            yield pdf
    return df.mapInPandas(run, schema)


def score_requests(requests: DataFrame, model: PipelineModel, numeric: list[str],
                   categorical: list[str], payload: str = "data",
                   id_cols: list[str] | tuple = ()) -> DataFrame:
    """M2/M3: JSON requests (one object or an array of objects, no size cap)
    -> one row per item; numeric fields that do not convert reject the item
    (error_message lists them) while the other items of the batch are
    scored.  Output follows the prediction-log schema."""
    from kredo.functions.payload import client_id
    from kredo.operators.encoding import invalid_numeric_fields
    text = F.trim(F.col(payload))
    arr = F.when(text.startswith("["), F.from_json(F.col(payload), "array<map<string,string>>")) \
        .otherwise(F.array(F.from_json(F.col(payload), "map<string,string>")))
    # a payload (or batch item) that is not a JSON object is kept as a
    # rejected row, never silently dropped
    arr = F.coalesce(arr, F.array(F.lit(None).cast("map<string,string>")))
    # the payload shape decides the type: an array is a batch request, even
    # with one item; an object is a single request
    items = requests.select(*id_cols, F.when(text.startswith("["), "batch").otherwise("single")
                            .alias("prediction_type"),
                            F.posexplode(arr).alias("item_no", "m"))
    fields = {c: F.col("m")[c] for c in numeric + categorical}
    flat = items.withColumns(fields)
    bad = F.when(F.col("m").isNull(), F.array(F.lit("<payload is not a JSON object>"))) \
        .otherwise(invalid_numeric_fields(numeric))
    flat = flat.withColumn("_bad", bad)
    typed = flat.withColumns({c: F.col(c).try_cast("double") for c in numeric})
    scored = predict_proba(typed, model, numeric, categorical)
    return scored.select(
        *id_cols, "item_no", "prediction_type",
        client_id(F.col("m")).alias("client_id"),
        F.to_json("m").alias("input_data"),
        F.when(F.size("_bad") == 0, F.col("score")).alias("score"),
        F.when(F.size("_bad") > 0, F.concat(F.lit("rejected: "),
                                           F.array_join("_bad", ","))).alias("error_message"))
