"""Pair weights: adaptive, uniform and distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.functions.validation import positive_number

W_MAX = 1e10


def _distances(pairs: DataFrame, theta: DataFrame) -> DataFrame:
    """Adds d: the distance of the ends' estimates; null if one is empty (null or NaN)."""
    clean = F.when(~F.isnan("theta"), F.col("theta"))
    at = lambda c: theta.select(F.col("group_id").alias(c), clean.alias(f"theta_{c}"))
    joined = pairs.join(at("u"), "u", "left").join(at("v"), "v", "left")
    return joined.withColumn("d", F.abs(F.col("theta_u") - F.col("theta_v"))).drop("theta_u", "theta_v")


def _power(d: Column, gamma: float) -> Column:
    return {1.0: d, 2.0: d * d, 0.5: F.sqrt(d)}.get(gamma, F.pow(d, F.lit(gamma)))


def adaptive_weights(pairs: DataFrame, theta: DataFrame, gamma: float = 1.0, w_max: float | None = None) -> DataFrame:
    """Adds weight: 1 / distance ** gamma, at most ``w_max``, which ties get; 1 (capped too) next to an empty group."""
    gamma, cap = positive_number(gamma, "gamma"), W_MAX if w_max is None else positive_number(w_max, "w_max")
    p = _power(F.col("d"), gamma)
    weight = F.when(F.col("d").isNull(), 1.0).when(p > 0, F.lit(1.0) / F.when(p > 0, p)).otherwise(cap)
    return _distances(pairs.drop("weight"), theta).withColumn("weight", F.least(weight, F.lit(cap))).drop("d")


def uniform_weights(pairs: DataFrame, value: float = 1.0) -> DataFrame:
    return pairs.drop("weight").withColumn("weight", F.lit(positive_number(value, "value")))


def distance_weights(pairs: DataFrame, theta: DataFrame) -> DataFrame:
    """Adds weight: the distance, 0 next to an empty group."""
    return _distances(pairs.drop("weight"), theta).withColumn("weight", F.coalesce("d", F.lit(0.0))).drop("d")
