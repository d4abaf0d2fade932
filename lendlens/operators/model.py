"""Gradient-boosted default model on Spark ML.

The whole ``Pipeline`` (imputer, assembler, classifier) is fitted on the
training split only and saved as one ``PipelineModel``, so feature names
travel with the model. Scores come back as plain double columns through
``vector_to_array``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.functions import rules
from lendlens.operators import clean as cl
from lendlens.operators import metrics as met


def class_weight_column(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """positives weighted neg/pos, negatives 1 (a scalar subquery supplies the ratio)."""
    ratio = df.select((F.count_if(F.col(label) == 0) / F.count_if(F.col(label) == 1)).cast("double")).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


def preprocessing_stages(numeric: list[str], categorical: list[str], scale: bool = False,
                         handle_invalid: str = "keep") -> tuple[list, list[str]]:
    """Impute -> (scale) -> index -> one-hot -> assemble, as pipeline stages."""
    stages, assembled = [], []
    if numeric:
        imp = [f"{c}__imp" for c in numeric]
        stages.append(Imputer(inputCols=numeric, outputCols=imp, strategy="mean"))
        assembled += imp
    if categorical:
        idx = [f"{c}__idx" for c in categorical]
        ohe = [f"{c}__ohe" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid=handle_invalid))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="keep"))
        assembled += ohe
    stages.append(VectorAssembler(inputCols=assembled, outputCol="features_raw" if scale else "features",
                                  handleInvalid=handle_invalid))
    if scale:
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features", withMean=False, withStd=True))
    return stages, assembled


def gbt_pipeline(numeric: list[str], categorical: list[str] = (), label: str = "label", weight_col=None,
                 seed: int = 42, **params) -> Pipeline:
    """preprocessing + GBTClassifier with the default hyper-parameters."""
    p = dict(rules.GBT_DEFAULTS)
    p.update(params)
    stages, _ = preprocessing_stages(list(numeric), list(categorical))
    gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **p)
    if weight_col:
        gbt.setWeightCol(weight_col)
    return Pipeline(stages=stages + [gbt])


def predict(model: PipelineModel, df: DataFrame, keep=None) -> DataFrame:
    """class prediction and ``default_probability`` = P(class 1)."""
    out = model.transform(df).withColumn("default_probability", vector_to_array("probability")[1])
    drop = [c for c in out.columns if c.endswith(("__imp", "__idx", "__ohe")) or c in
            ("features", "features_raw", "rawPrediction", "probability")]
    out = out.drop(*drop)
    return out.select(*keep, "prediction", "default_probability") if keep else out


def batch_score(model: PipelineModel, df: DataFrame, columns: list[str], key: str = "application_id",
                defaults: dict | None = None) -> DataFrame:
    """align to the model's columns (missing -> default 0), score, decide."""
    defaults = defaults or {}
    aligned = cl.align_to_columns(df, [key, *columns], defaults)
    scored = predict(model, aligned, keep=[key])
    return met.decisions(scored, prob="default_probability").withColumn(
        "recommendation", F.when(F.col("decision") == "approved", F.lit("APPROVE")).otherwise(F.lit("REJECT")))


def evaluate(model: PipelineModel, test: DataFrame, label: str = "label") -> dict:
    """AUC-ROC, AUC-PR, accuracy, weighted precision / recall, F1."""
    pred = model.transform(test).cache()
    try:
        b = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction")
        m = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction")
        return {
            "auc_roc": b.evaluate(pred, {b.metricName: "areaUnderROC"}),
            "auc_pr": b.evaluate(pred, {b.metricName: "areaUnderPR"}),
            "accuracy": m.evaluate(pred, {m.metricName: "accuracy"}),
            "precision": m.evaluate(pred, {m.metricName: "weightedPrecision"}),
            "recall": m.evaluate(pred, {m.metricName: "weightedRecall"}),
            "f1": m.evaluate(pred, {m.metricName: "f1"}),
        }
    finally:
        pred.unpersist()


def feature_importances(model: PipelineModel, df: DataFrame) -> DataFrame:
    """importance per source column (small table: one row per column).

    The assembled vector's slots are named by its ML attributes, read from the
    schema of a transformed (empty) frame; the slots of a one-hot column add
    up to their source column, and a column that got no slot counts 0."""
    out = model.transform(df.limit(0))
    attrs = out.schema["features"].metadata["ml_attr"]["attrs"]
    slots = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    importances = model.stages[-1].featureImportances.toArray().tolist()
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    total = {c.rsplit("__", 1)[0]: 0.0 for c in assembler.getInputCols()}
    for i, v in enumerate(importances):
        source = next(c for c in assembler.getInputCols() if slots[i] == c or slots[i].startswith(c + "_"))
        total[source.rsplit("__", 1)[0]] += float(v)
    return df.sparkSession.createDataFrame(list(total.items()), "feature string, importance double")


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    """S3: top-n features by importance."""
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def fold_column(df: DataFrame, key: str, label: str = "label", folds: int = 5, seed: int = 42,
                out: str = "fold") -> DataFrame:
    """deterministic fold per row from the key hash, drawn per class (stratified in
    expectation, without a shuffle; ``rank.stratified_folds`` is exact)."""
    h = met.hash_fraction(F.concat_ws(":", F.col(key).cast("string"), F.col(label).cast("string")), seed)
    return df.withColumn(out, F.least(F.floor(h * folds), F.lit(folds - 1)).cast("int"))


def grid_search(pipeline: Pipeline, train: DataFrame, grid=None, label: str = "label", folds_col: str = "fold",
                parallelism: int = 4):
    """CrossValidator over a parameter grid with a fold column, by AUC."""
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    gbt = pipeline.getStages()[-1]
    if grid is None:
        grid = (ParamGridBuilder().addGrid(gbt.maxDepth, [3, 5, 7]).addGrid(gbt.stepSize, [0.01, 0.1, 0.3])
                .addGrid(gbt.maxIter, [50, 100, 200]).addGrid(gbt.subsamplingRate, [0.8, 1.0])
                .addGrid(gbt.featureSubsetStrategy, ["0.8", "1.0"]).build())
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid,
                        evaluator=BinaryClassificationEvaluator(labelCol=label),
                        foldCol=folds_col, parallelism=parallelism)
    return cv.fit(train)


def cv_summary(cv_model) -> DataFrame:
    """mean and standard deviation over the folds of each grid point's AUC, best first."""
    rows = [({p.name: str(v) for p, v in params.items()}, float(m), float(s)) for params, m, s in
            zip(cv_model.getEstimatorParamMaps(), cv_model.avgMetrics, cv_model.stdMetrics, strict=True)]
    return SparkSession.active().createDataFrame(rows, "params map<string,string>, auc_mean double, auc_std double") \
        .orderBy(F.desc("auc_mean"))


METADATA_SCHEMA = ("model_type string, trained_at string, features array<string>, n_train long, n_test long, "
                   "metrics map<string,double>, parameters map<string,string>")


def save_model(model: PipelineModel, path: str, metadata: dict | None = None) -> None:
    """A3 / A4: overwrite-save the whole pipeline, and its metadata as one JSON document next to it."""
    model.write().overwrite().save(path)
    if metadata is not None:
        SparkSession.active().createDataFrame([metadata], METADATA_SCHEMA) \
            .coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "_metadata")


def load_metadata(spark: SparkSession, path: str) -> dict:
    """A4: the metadata saved with a model."""
    return spark.read.schema(METADATA_SCHEMA).json(path.rstrip("/") + "_metadata").first().asDict(recursive=True)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
