"""Training sets, splits and models on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scan import TARGET_ROWS, Running, running
from ..sources.schemas import MODEL_FEATURES
from .features import model_columns

KEYS = ["source_id", "txn_id"]


def training_set(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of labelled transactions, FRAUD as 1.0; rows with any gap are dropped."""
    label = F.when(F.col("label") == "FRAUD", 1.0).otherwise(0.0)
    return features.join(labels.select(*KEYS, label.alias("label")), KEYS).na.drop()


def class_weights(data: DataFrame) -> DataFrame:
    """Class sizes, the weight that balances the positives, and whether the set is large enough."""
    sizes = data.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("label") == 1.0, 1)).alias("positive"),
        F.count(F.when(F.col("label") != 1.0, 1)).alias("negative"),
    )
    enough = (F.col("total") >= 20) & (F.col("positive") >= 5) & (F.col("negative") >= 5)
    weight = F.when(F.col("positive") > 0, F.col("negative") / F.col("positive"))
    return sizes.select("*", weight.alias("positive_weight"), enough.alias("trainable"))


def weighted(data: DataFrame, positive_weight: float) -> DataFrame:
    return data.withColumn("class_weight", F.when(F.col("label") == 1.0, positive_weight).otherwise(1.0))


def stratified_split(data: DataFrame, every: int = 5, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add ``is_validation``: each class ordered by a hash of the key, every fifth row.

    Hash values are even, so their upper bits cut a class into equal ranges of about ``target_rows``
    rows, which are ranked apart.
    """
    range_bits = max(1, math.ceil(math.log2(max(1, data.count() / target_rows) + 1)))
    hashed = data.withColumn("_hash", F.xxhash64(*KEYS))
    ranged = hashed.withColumn("_range", F.shiftright("_hash", 64 - range_bits))
    ranked = running(ranged, ["label"], ["_range"], ["_hash", *KEYS], [Running("_rank", F.lit(1).cast("bigint"))])
    return ranked.select(*data.columns, (F.col("_rank") % every == 0).alias("is_validation"))


def _fit(data: DataFrame, classifier) -> PipelineModel:
    assembler = VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features")
    return Pipeline(stages=[assembler, classifier]).fit(data)


def train_forest(data: DataFrame, trees: int = 80, depth: int = 7, seed: int = 42) -> PipelineModel:
    """Weighted random forest; ``data`` carries ``label`` and ``class_weight``."""
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", weightCol="class_weight", numTrees=trees, maxDepth=depth, seed=seed
    )
    return _fit(data, forest)


def train_tree(data: DataFrame, depth: int = 4, seed: int = 42) -> PipelineModel:
    """One explainable tree."""
    tree = DecisionTreeClassifier(labelCol="label", featuresCol="features", weightCol="class_weight", maxDepth=depth, seed=seed)
    return _fit(data, tree)


def prepared(data: DataFrame) -> DataFrame:
    """Weights and split added; raises where the classes are too small to train on."""
    sizes = class_weights(data).first()
    if not sizes["trainable"]:
        raise ValueError("too few labels to train on: 20 rows are needed, 5 of each class")
    return stratified_split(weighted(data, sizes["positive_weight"]))


def score(model: PipelineModel, features: DataFrame, out: str = "fraud_score") -> DataFrame:
    """Add the probability of the fraud class."""
    scored = model.transform(features).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def scorer(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """The model as a scorer of ``decide``: adds ``fraud_score`` to transactions with features as of their time."""

    def add(as_of: DataFrame) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        filled = as_of.withColumn("_row", F.struct(*as_of.columns)).withColumns({c: F.coalesce(c, zero) for c in ("daily_amount", "daily_count")})
        return score(model, filled.select("_row", *model_columns())).select("_row.*", "fraud_score")

    return add


def validation_scores(model: PipelineModel, split: DataFrame, name: str) -> DataFrame:
    """(model, label, score) of the rows that the model was not trained on, for the metrics."""
    held = split.filter("is_validation")
    return score(model, held).select(F.lit(name).alias("model"), F.col("label").cast("int").alias("label"), F.col("fraud_score").alias("score"))


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(MODEL_FEATURES, values)), "feature string, importance double")


def tree_lines(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The tree's branches as numbered text lines with feature names."""
    text = model.stages[-1].toDebugString
    for i in reversed(range(len(MODEL_FEATURES))):
        text = text.replace(f"feature {i} ", f"{MODEL_FEATURES[i]} ")
    lines = [(n, line.rstrip()) for n, line in enumerate(text.splitlines())]
    return spark.createDataFrame(lines, "line bigint, rule string")


def save_artifact(model: PipelineModel, metrics: DataFrame, path: str, manifest: dict[str, str], columns: Sequence[str] = MODEL_FEATURES) -> None:
    """The fitted pipeline, its metrics and a manifest under one path."""
    spark = metrics.sparkSession
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    schema = T.StructType([T.StructField(k, T.StringType()) for k in manifest])
    rows = spark.createDataFrame([tuple(manifest.values())], schema).withColumn("feature_columns", F.array(*[F.lit(c) for c in columns]))
    rows.write.mode("overwrite").json(f"{path}/manifest")


def load_artifact(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
