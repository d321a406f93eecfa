"""Classification of samples from sites of their sequences or from vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

CATEGORIES = ("A", "C", "G", "T", "N", "-")


def site_features(df: DataFrame, sequence: str, sites: list[int]) -> DataFrame:
    """Adds ``onehot``: for every site six indicators in the order of CATEGORIES; other letters count as N."""
    base = lambda i: F.substring(F.col(sequence), i + 1, 1)
    known = [F.when(base(i).isin(*CATEGORIES), base(i)).otherwise("N") for i in sites]
    return df.withColumn("onehot", F.array(*(F.when(b == c, 1.0).otherwise(0.0) for b in known for c in CATEGORIES)))


def train(df: DataFrame, features: str, label: str, depth: int = 5) -> PipelineModel:
    """A decision tree on array features."""
    vectors = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("string").alias("label_text"))
    return Pipeline(stages=[StringIndexer(inputCol="label_text", outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc"), DecisionTreeClassifier(maxDepth=depth, seed=1)]).fit(vectors)


def classify(df: DataFrame, model: PipelineModel, features: str, key: str) -> DataFrame:
    """(key, assigned, probability): the likeliest class; of equals the first."""
    names = F.array(*map(F.lit, model.stages[0].labels))
    scored = model.stages[1].transform(df.withColumn("features", array_to_vector(F.col(features).cast("array<double>"))))
    p = vector_to_array("probability")
    return scored.select(key, F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")).alias("assigned"), F.array_max(p).alias("probability"))
