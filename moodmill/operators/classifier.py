"""Classifiers fitted and applied with Spark MLlib."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from moodmill.functions.vectors import dot
from moodmill.session import durable

# Default layer sizes of the head, and the seed.
MLP_SIZES = (100, 50, 11)
SEED = 228


@dataclass(frozen=True)
class MultiHeadModel:
    """Coefficients and intercept of one binary classifier per head."""

    coefficients: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]


def classifier_fit(
    features: DataFrame, dim: int, sizes: tuple[int, ...] = MLP_SIZES, target: str = "target",
    vector: str = "vector", max_iter: int = 100, seed: int = SEED,
) -> MultilayerPerceptronClassificationModel:
    """Fit a multilayer perceptron with cross-entropy loss on ``vector, target``.

    The learner keeps its own copy of the rows for its iterations.
    """
    rows = features.select(
        F.col(target).cast("double").alias("label"), array_to_vector(F.col(vector)).alias("_features")
    )
    learner = MultilayerPerceptronClassifier(
        layers=[dim, *sizes], featuresCol="_features", labelCol="label", maxIter=max_iter, seed=seed,
        predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw",
    )
    return learner.fit(rows)


def classifier_of_weights(
    spark: SparkSession, sizes: tuple[int, ...], weights: list[float]
) -> MultilayerPerceptronClassificationModel:
    """A perceptron with given weights: per layer the matrix column by column, then the bias."""
    row = spark.createDataFrame([(0.0, [0.0] * sizes[0])], "label double, vector array<double>")
    learner = MultilayerPerceptronClassifier(
        layers=list(sizes), featuresCol="_features", labelCol="label", maxIter=0, initialWeights=Vectors.dense(weights),
        predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw",
    )
    # Without an iteration the learner returns what it began with.
    return learner.fit(row.select("label", array_to_vector("vector").alias("_features")))


def classifier_predict(
    model: MultilayerPerceptronClassificationModel, df: DataFrame, vector: str = "vector"
) -> DataFrame:
    """Add ``logits`` and ``prediction``; a projection."""
    scored = model.transform(df.withColumn("_features", array_to_vector(F.col(vector))))
    return scored.select(
        *df.columns, vector_to_array("_raw").alias("logits"), F.col("_prediction").cast("int").alias("prediction")
    )


def classifier_fit_multi_head(
    features: DataFrame, heads: int, target: str = "target", max_iter: int = 100
) -> MultiHeadModel:
    """Fit one binary classifier per head on that head's vectors ``(head, vector, target)``.

    Head ``h`` tells class ``h`` from the rest. The features are written once by
    head, so that each fit reads its own part only.
    """
    rows = durable(features.select("vector", F.col(target).alias("t"), "head"), "heads", partition_by="head")
    coefficients, intercepts = [], []
    for head in range(heads):
        learner = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=max_iter, regParam=1e-4)
        fitted = learner.fit(
            rows.where(F.col("head") == head).select(
                (F.col("t") == head).cast("double").alias("_label"), array_to_vector("vector").alias("_features")
            )
        )
        coefficients.append(tuple(float(x) for x in fitted.coefficients))
        intercepts.append(float(fitted.intercept))
    return MultiHeadModel(tuple(coefficients), tuple(intercepts))


def classifier_predict_multi_head(model: MultiHeadModel, features: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, logits, prediction``: the logits of all heads side by side."""
    heads = range(len(model.intercepts))
    rows = "[" + ",".join("[" + ",".join(map(repr, c)) + "]" for c in model.coefficients) + "]"
    table = F.from_json(F.lit(rows), "array<array<double>>")
    bias = F.from_json(F.lit("[" + ",".join(map(repr, model.intercepts)) + "]"), "array<double>")
    scored = features.select(
        *keys, "head",
        (dot(F.col("vector"), F.get(table, F.col("head"))) + F.get(bias, F.col("head"))).alias("logit"),
    )
    wide = scored.groupBy(*keys).agg(
        F.array(*[F.max(F.when(F.col("head") == h, F.col("logit"))) for h in heads]).alias("logits")
    )
    best = F.array_position(F.col("logits"), F.array_max("logits")) - 1
    return wide.select(*keys, "logits", best.cast("int").alias("prediction"))
