"""A false-positive classifier over finding features: a small perceptron by Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.code import is_test

#: Detectors hash to so many one-hot features; then severity, text, place, span and kind.
HASHED = 15
TEXT = ("eval", "exec", "select", "password", "token", "http", "debug", "test", "mock", "todo", "unsafe", "unwrap", "log", "import", "return", "import_", "open", "key", "random", "hash", "cookie", "regex", "loop", "async", "class")


def features(findings: DataFrame) -> DataFrame:
    """findings with `features`: an array of doubles between 0 and 1."""
    kind = F.pmod(F.xxhash64("detector"), F.lit(HASHED))
    one = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    title = F.lower("title")
    span = F.coalesce(F.col("line_end") - F.col("line_start") + 1, F.lit(1))
    parts = [one(kind == i) for i in range(HASHED)] + [one(F.col("severity") >= i) for i in range(1, 5)] + [one(title.contains(t)) for t in TEXT]
    parts += [one(is_test(F.col("file"))), one(F.col("file").rlike(r"(^|/)(vendor|node_modules|dist|build|generated)/")), F.least(F.lit(1.0), span / 100.0), F.least(F.lit(1.0), F.length("title") / 200.0), one(F.col("cwe_id").isNotNull()), F.coalesce("confidence", F.lit(0.7))]
    return findings.withColumn("features", F.array(*parts))


def train(findings: DataFrame, label: str, hidden: int = 32, rounds: int = 100, seed: int = 1) -> MultilayerPerceptronClassificationModel:
    rows = features(findings).select(array_to_vector("features").alias("features"), F.col(label).cast("double").alias("label"))
    width = HASHED + 4 + len(TEXT) + 6
    return MultilayerPerceptronClassifier(layers=[width, hidden, 2], maxIter=rounds, blockSize=32, seed=seed).fit(rows)


def score(findings: DataFrame, model: MultilayerPerceptronClassificationModel) -> DataFrame:
    """Adds tp_score, the probability that a finding is true."""
    rows = features(findings).withColumn("features", array_to_vector("features"))
    return model.transform(rows).withColumn("tp_score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
