"""Boosted-tree forecasts with a hold-out that ends the boosting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(rows: DataFrame, features: Sequence[str], target: str, rounds: int = 40, depth: int = 4, rate: float = 0.1, share: float = 0.8, held_out: Column | None = None, tolerance: float = 0.01, seed: int = 7):
    """A pipeline model of gradient-boosted trees on the target; rows with a null among the features or in the target are left out. With ``held_out``
    these rows are not fitted on: boosting ends when they gain less than the tolerance."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    tree = GBTRegressor(featuresCol="_features", labelCol=target, maxDepth=depth, maxIter=rounds, stepSize=rate, subsamplingRate=share, seed=seed, validationTol=tolerance)
    rows = rows.filter(F.col(target).isNotNull())
    if held_out is not None:
        rows, tree = rows.withColumn("_held_out", held_out), tree.setValidationIndicatorCol("_held_out")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip"), tree]).fit(rows)


def predict(model, rows: DataFrame) -> DataFrame:
    """Adds prediction."""
    return model.transform(rows).drop("_features", "_held_out")


def mean_error(model, rows: DataFrame, target: str) -> DataFrame:
    """One row: n and the mean absolute error."""
    return predict(model, rows).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("prediction") - F.col(target))).alias("mae"))
