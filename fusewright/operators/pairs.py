"""Canonical pairs: no loops, u < v, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions.schemas import require
from fusewright.functions.validation import DUPLICATES, check_groups, check_pairs, choice, guard


def canonicalize(pairs: DataFrame, how: str = "first") -> DataFrame:
    """u, v and weight; duplicates are merged by ``how`` (``first``: of the least pair_idx)."""
    how = choice(how, DUPLICATES, "duplicate strategy")
    pairs = require(pairs, "pair_idx", "u", "v", "weight") if how == "first" else require(pairs, "u", "v", "weight")
    merged = {"first": lambda: F.min_by("weight", "pair_idx"), "sum": lambda: F.sum("weight"), "mean": lambda: F.sum("weight").cast("double") / F.count("*"), "max": lambda: F.max("weight"), "min": lambda: F.min("weight")}[how]()
    ordered = pairs.filter("u <> v").withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})
    return ordered.groupBy("u", "v").agg(merged.cast("double").alias("weight"))


def infer_n_params(canonical: DataFrame) -> int:
    """The largest id plus one, or 0."""
    top = canonical.agg(F.max("v")).head()[0]
    return 0 if top is None else top + 1


def check_fusion_pairs(pairs: DataFrame, n_params: int | None = None, how: str = "first") -> tuple[DataFrame, int]:
    """Validated canonical pairs and the number of parameters."""
    choice(how, DUPLICATES, "duplicate strategy")
    check_pairs(pairs, n_params)
    canonical = canonicalize(pairs, how)
    return canonical, infer_n_params(canonical) if n_params is None else n_params


def guarded_pairs(pairs: DataFrame, n_params: int, how: str = "first") -> DataFrame:
    """Canonical pairs below ``n_params`` that are validated by the job that reads them: no job runs before, and a bad pair is that job's error."""
    for c in ("u", "v"):
        pairs = guard(pairs, c, non_negative=True, upper=n_params, inclusive=False)
    return canonicalize(guard(pairs, "weight", positive=True), how)


def check_groups_and_pairs(obs: DataFrame, pairs: DataFrame, n_groups: int | None = None, how: str = "first") -> tuple[int, DataFrame]:
    """The number of groups and the canonical pairs between them."""
    n = check_groups(obs, n_groups)
    return n, check_fusion_pairs(pairs, n, how)[0]


def chain(spark, n: int) -> DataFrame:
    """Pairs (k, k + 1) of a series of ``n``."""
    return spark.range(max(0, n - 1)).select(F.col("id").alias("pair_idx"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("weight"))
