"""Selection by rounds of counting against sorting, and the operators that use it on hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from fusewright.operators.prox import solve_scalar, weighted_median
from fusewright.operators.selection import crossings

SHAPES = {
    "uniform": lambda rng: rng.uniform(-5, 5),
    "ties": lambda rng: float(rng.randrange(4)),
    "one value": lambda rng: 2.0,
    "mostly the largest": lambda rng: 9.0 if rng.random() < 0.97 else rng.random(),
    "mostly the least": lambda rng: -9.0 if rng.random() < 0.97 else rng.random(),
    "wide": lambda rng: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 308),
    "huge": lambda rng: rng.choice([-1.7e308, 1.7e308, rng.random()]),
    "tiny": lambda rng: rng.randrange(5) * 5e-324,
}


@pytest.mark.parametrize("leaf", [1, 7, 10_000])
def test_ranks_of_all_shapes(spark, leaf):
    rng = random.Random(leaf)
    data = {k: sorted(shape(rng) for _ in range(400)) for k, shape in enumerate(SHAPES.values())}
    rows = [(k, z, j) for k, zs in data.items() for j, z in enumerate(rng.sample(zs, len(zs)))] + [(90, 1.0, 0)]
    values = spark.createDataFrame(rows, "key long, z double, tie long").withColumn("w", F.lit(1).cast("long"))
    asked = [(k, t, rank) for k in [*data, 90, 91] for t, rank in enumerate((1, 2, 57, 200, 399, 400, 401))]
    targets = spark.createDataFrame(asked, "key long, t int, rank long")
    got = {(r["key"], r["t"]): r for r in crossings(values, targets, "key", lambda z, upto: upto >= F.col("rank"), leaf).collect()}
    assert len(got) == len(asked)
    for k, t, rank in asked:
        zs = data.get(k, [1.0] if k == 90 else [])
        r = got[k, t]
        if rank > len(zs):
            assert r["z"] is None
        else:
            assert r["z"] == zs[rank - 1] and r["before"] < rank <= r["upto"]
            assert zs[r["before"]] == zs[r["upto"] - 1] == r["z"]


def test_decimals(spark):
    values = spark.range(5000).select((F.col("id") % 2).alias("key"), (F.pmod(F.col("id") * 7919, F.lit(5003)) / 100).cast("decimal(18,2)").alias("z"), F.col("id").alias("tie"), F.lit(1).cast("long").alias("w"))
    targets = spark.createDataFrame([(0, 0, 1250), (1, 0, 2500)], "key long, t int, rank long")
    holds = lambda z, upto: upto >= F.col("rank")
    by = [sorted(tuple(r) for r in crossings(values, targets, "key", holds, leaf).collect()) for leaf in (10_000, 50)]
    assert by[0] == by[1]


def test_problems_with_hubs(spark):
    """Every tenth problem has a thousand neighbours; they are solved by rounds, and as in one window."""
    rng = random.Random(7)
    sizes = [1000 if k % 10 == 0 else rng.randrange(6) for k in range(60)]
    n = [rng.choice([0.0, rng.uniform(1, 30)]) for _ in sizes]
    problems = spark.createDataFrame([(k, n[k], rng.uniform(-900, 900), rng.choice([0.0, 0.3, 2.0])) for k in range(60)], "problem_id long, n double, s double, lam double")
    weight = [rng.choice([0.0, 1.0]) if k % 4 else 1.0 for k in range(60)]
    nbrs = spark.createDataFrame([(k, j, rng.choice([rng.uniform(-9, 9), 1.5]), weight[k] * rng.uniform(0, 2)) for k, r in enumerate(sizes) for j in range(r)], "problem_id long, nbr long, z double, w double")
    whole = {r["problem_id"]: r["x"] for r in solve_scalar(problems, nbrs).collect()}
    for leaf in (3, 40):
        assert {r["problem_id"]: r["x"] for r in solve_scalar(problems, nbrs, leaf=leaf).collect()} == pytest.approx(whole, rel=1e-12)
    assert len(whole) == 60
    values = nbrs.withColumnRenamed("problem_id", "key")
    assert {r["key"]: r["x"] for r in weighted_median(values, 5).collect()} == {r["key"]: r["x"] for r in weighted_median(values).collect()}
