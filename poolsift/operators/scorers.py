"""Scorers for the round loop: fit on the labelled rows, add a ``logits`` column to others.

A scorer is ``fit(labelled) -> (rows -> rows with logits)``.  What it fits is sent to the
tasks, so it must be small: class means (classes x dimensions numbers) or a
linear model.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot

Scorer = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def class_means(rows: DataFrame, num_classes: int, label: str = "label", vec: str = "embedding") -> list[list[float]]:
    """Mean vector per class 0..num_classes-1; zeros for a class without rows."""
    values = rows.filter(F.col(label).between(0, num_classes - 1)).select(label, F.posexplode(vec).alias("pos", "v"))
    means = values.groupBy(label, "pos").agg(F.avg("v").alias("m")).collect()      # classes x dimensions
    width = 1 + max((r["pos"] for r in means), default=-1)
    out = [[0.0] * width for _ in range(num_classes)]
    for r in means:
        out[r[label]][r["pos"]] = float(r["m"])
    return out


def with_mean_logits(rows: DataFrame, means: list[list[float]], scale: float, vec: str = "embedding") -> DataFrame:
    """``logits``: scaled dot products of the whole vector with every class mean."""
    # one array constant, folded once by the optimiser
    centres = F.from_json(F.lit(json.dumps(means)), "array<array<double>>")
    return rows.withColumn("logits", F.transform(centres, lambda c: dot(F.col(vec), c) * F.lit(scale)))


def mean_scorer(num_classes: int, scale: float, label: str = "label", vec: str = "embedding") -> Scorer:
    """The class means of the labelled rows as a model in closed form."""
    def fit(labelled: DataFrame):
        means = class_means(labelled, num_classes, label, vec)
        return lambda rows: with_mean_logits(rows, means, scale, vec)
    return fit


def _features(df: DataFrame, vec: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("features", array_to_vector(F.col(vec)))


def score_with(model, df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Model logits (raw predictions) as ``logits ARRAY<DOUBLE>``."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(_features(df, vec))
    return out.withColumn("logits", vector_to_array("rawPrediction")) \
        .drop("features", "rawPrediction", "probability", "prediction")


def logistic_scorer(label: str = "label", vec: str = "embedding", make=None) -> Scorer:
    """MLlib logistic regression (or what ``make()`` returns), refitted from scratch."""
    def fit(labelled: DataFrame):
        from pyspark.ml.classification import LogisticRegression

        # iterative fit: keep the (budget-sized) training rows materialised for its passes
        train = _features(labelled, vec).persist(StorageLevel.MEMORY_AND_DISK)
        model = (make() if make else LogisticRegression(maxIter=50, regParam=0.01, labelCol=label)).fit(train)
        train.unpersist()
        return lambda rows: score_with(model, rows, vec)
    return fit
