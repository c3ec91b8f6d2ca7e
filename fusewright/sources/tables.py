"""The driver's tables in the roles of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs: line items' prices by supplier, exact to the cent."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("group_id"), F.col("l_extendedprice").cast(MONEY).alias("y"))


def user_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs: events' values by user."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("obs_idx"), F.col("user_id").alias("group_id"), F.col("value").cast(MONEY).alias("y"))


def nation_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs: suppliers' balances by nation; small tables leave nations empty."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("obs_idx"), F.col("s_nationkey").alias("group_id"), F.col("s_acctbal").cast(MONEY).alias("y"))


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs: a multigraph with loops and duplicates, from each event's user to one of fifty."""
    events = table(spark, sf_dir, "events")
    n = events.agg((F.max("user_id") + 1).alias("n"))
    joined = events.crossJoin(F.broadcast(n))  # one row
    return joined.select(F.col("event_id").alias("pair_idx"), F.col("user_id").alias("u"), F.pmod(F.pmod("event_id", F.lit(50)), "n").alias("v"), (F.col("value") + 1).cast(MONEY).alias("weight"))


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs: all nations of a region with one another."""
    nation = table(spark, sf_dir, "nation")
    a, b = nation.select(F.col("n_nationkey").alias("u"), "n_regionkey"), nation.select(F.col("n_nationkey").alias("v"), "n_regionkey")
    both = a.join(b, "n_regionkey").filter("u < v")
    return both.select((F.col("u") * 1000 + F.col("v")).cast("long").alias("pair_idx"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), (F.col("u") + F.col("v") + 1).cast("double").alias("weight"))


#: Neighbours of the generated problems.
SIZES = (5, 20, 50, 100, 200, 500)


def benchmark_problems(spark: SparkSession, per_size: int = 20, sizes: tuple[int, ...] = SIZES, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Deterministic problems of each size from integer arithmetic, so any engine can make the same; one for each id of ``ids`` (from 0), if given."""
    ids = spark.range(len(sizes) * per_size) if ids is None else ids.select("id")
    ids = ids.select(F.col("id").alias("problem_id"), F.element_at(F.array(*[F.lit(x) for x in sizes]), (F.col("id") % len(sizes) + 1).cast("int")).alias("r"))
    unit = lambda a, b: F.pmod((F.col("problem_id") + 1) * a + (F.col("nbr") + 1) * b, F.lit(10007)) / F.lit(10007.0)
    # a join, as the optimiser takes exploded rows to be no more than those they come from and would broadcast them
    nbrs = ids.join(F.broadcast(spark.range(max(sizes)).withColumnRenamed("id", "nbr")), F.col("nbr") < F.col("r"))
    nbrs = nbrs.select("problem_id", "nbr", (unit(7919, 104729) * 20 - 10).alias("z"), (unit(6151, 3571) * 1.5 + 0.5).alias("w"))
    one = lambda a: F.pmod((F.col("problem_id") + 1) * a, F.lit(10007)) / F.lit(10007.0)
    n = (one(4409) * 90 + 10).alias("n")
    problems = ids.select("problem_id", n, one(2503).alias("m"), (one(9001) * 4.9 + 0.1).alias("lam")).select("problem_id", "n", ((F.col("m") * 100 - 50) * F.col("n")).alias("s"), "lam")
    return problems, nbrs
