"""Learned fusion: gradient-boosted trees or a small network over 15 features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.operators.retrieval import rrf, top_k

FEATURES = [f"f{i}" for i in range(15)]


def train(features: DataFrame, relevant: DataFrame, kind: str = "gbt") -> PipelineModel | None:
    """``relevant`` has id and label (0/1).  None if only one label occurs."""
    rows = features.join(relevant, "id").select("id", F.col("label").cast("double").alias("label"), *FEATURES).cache()
    if rows.select("label").distinct().count() < 2:
        return None
    steps = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]
    if kind == "gbt":
        steps.append(GBTClassifier(featuresCol="x", maxIter=20, maxDepth=3, seed=42))
    elif kind == "mlp":
        steps.append(MultilayerPerceptronClassifier(featuresCol="x", layers=[15, 64, 32, 2], maxIter=100, seed=42))
    else:
        raise ValueError(f"unknown model: {kind}")
    return Pipeline(stages=steps).fit(rows)


def fuse(model: PipelineModel | None, features: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The k best by the chance of relevance; reciprocal ranks without a model."""
    if model is None:
        return rrf(hits, k).select("id", "score", "rank")
    scored = model.transform(features).select("id", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("score"))
    return top_k(scored, k)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
