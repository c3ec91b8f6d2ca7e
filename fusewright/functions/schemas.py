"""Logical tables and how inputs are brought to them.

obs(obs_idx, group_id, y), pairs(pair_idx, u, v, weight), theta(group_id, theta; null: empty
group), problems(problem_id, n, s, lam) with nbrs(problem_id, nbr, z, w).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDS = ("obs_idx", "group_id", "pair_idx", "u", "v", "problem_id", "nbr", "node")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` narrowed to ``columns``: ids as BIGINT, whole DECIMALs as they are (their sums are exact), other numbers as DOUBLE."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    out = []
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, T.NumericType):
            raise ValueError(f"{c} must be numeric, it is {kind.simpleString()}")
        if c in IDS:
            if isinstance(kind, (T.FractionalType,)):
                whole = F.col(c).isNull() | (F.col(c) == F.floor(c))
                finite = F.col(c).isNull() | ~(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")))
                out.append(F.when(F.assert_true(finite & whole, F.lit(f"{c} must hold whole numbers")).isNull(), F.col(c).cast("long")).alias(c))
            else:
                out.append(F.col(c).cast("long").alias(c))
        else:
            out.append(F.col(c) if isinstance(kind, T.DecimalType) else F.col(c).cast("double").alias(c))
    return df.select(*out)


def pairs_from_array(spark: SparkSession, pairs: Sequence[Sequence[int]], weights: Iterable[float] | None = None) -> DataFrame:
    """A local list of pairs as a table; n rows of two, or else two rows of n."""
    rows = [list(p) for p in pairs]
    if any(len(r) != 2 for r in rows):
        if len(rows) != 2 or len(rows[0]) != len(rows[1]):
            raise ValueError("pairs must have the shape (n, 2) or (2, n)")
        rows = [list(p) for p in zip(*rows)]
    given = [1.0] * len(rows) if weights is None else [float(w) for w in weights]
    if len(given) != len(rows):
        raise ValueError(f"weights has length {len(given)}, expected {len(rows)}")
    return spark.createDataFrame([(k, int(u), int(v), w) for k, ((u, v), w) in enumerate(zip(rows, given))], "pair_idx long, u long, v long, weight double")


def pairs_from_column(df: DataFrame, pair: str = "pair", pair_idx: str = "pair_idx", weight: str | None = None) -> DataFrame:
    """A table with a pair in an array column, the layout (n, 2), as pairs. An array of another size is an error of the job."""
    two = F.when(F.assert_true(F.coalesce(F.size(pair) == 2, F.lit(False)), F.lit("pairs must have the shape (n, 2)")).isNull(), F.col(pair))
    return df.select(F.col(pair_idx).cast("long").alias("pair_idx"), two[0].cast("long").alias("u"), two[1].cast("long").alias("v"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("weight"))


def pairs_from_lists(df: DataFrame, first: str = "u", second: str = "v", pair_idx: str = "pair_idx", weight: str | None = None) -> DataFrame:
    """A table with lists of first and of second ends (and of pair_idx and weights), the layout (2, n) in rows of any length, as pairs. Lists of different lengths are an error of the job."""
    columns = [first, second, pair_idx, *([] if weight is None else [weight])]
    equal = F.coalesce(F.array_max(F.array(*[F.size(c) for c in columns])) == F.array_min(F.array(*[F.size(c) for c in columns])), F.lit(False))
    lists = F.arrays_zip(*[F.col(c).alias(n) for c, n in zip(columns, ("u", "v", "pair_idx", "weight"))])
    checked = F.when(F.assert_true(equal, F.lit("the lists of a pair's ends must be equally long")).isNull(), lists)
    e = df.select(F.explode(checked).alias("e"))
    return e.select(F.col("e.pair_idx").cast("long").alias("pair_idx"), F.col("e.u").cast("long").alias("u"), F.col("e.v").cast("long").alias("v"), (F.lit(1.0) if weight is None else F.col("e.weight").cast("double")).alias("weight"))


def obs_from_arrays(spark: SparkSession, y: Sequence[float], groups: Sequence[int]) -> DataFrame:
    if len(y) != len(groups):
        raise ValueError(f"groups has length {len(groups)}, expected {len(y)}")
    return spark.createDataFrame([(k, int(g), float(v)) for k, (g, v) in enumerate(zip(groups, y))], "obs_idx long, group_id long, y double")


def spine(spark: SparkSession, n: int, name: str = "group_id") -> DataFrame:
    """0 to n-1; one partition per million ids."""
    return spark.range(0, n, 1, max(1, -(-n // 1_000_000))).withColumnRenamed("id", name)
