"""Groups spread over tasks give what windows over whole groups give."""

import random

import pytest
from pyspark.sql import functions as F

from fusewright.functions.ordering import in_parts, running
from fusewright.operators.location import location

SHAPES = {
    "uniform": lambda rng: round(rng.uniform(-500, 500), 2), "ties": lambda rng: float(rng.randrange(3)), "one value": lambda rng: 7.25,
    "outliers": lambda rng: round(rng.gauss(0, 1), 2) if rng.random() < 0.9 else 1e6, "falling": lambda rng: round(1000 / (1 + rng.randrange(900)), 2),
}


@pytest.fixture(scope="module")
def obs(spark):
    rng = random.Random(2)
    rows = [(g, shape(rng)) for g, shape in enumerate(SHAPES.values()) for _ in range(rng.randrange(300, 400))]
    rows += [(g, float(rng.randrange(50))) for g in range(5, 12) for _ in range(g - 4)] + [(13, 4.0)] * 40
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "group_id long, y double").repartition(6).cache()


@pytest.mark.parametrize("kind", ["double", "decimal(18,2)"])
@pytest.mark.parametrize(("method", "options"), [
    ("median", {}), ("trimmed_mean", {"trim": 0.0}), ("trimmed_mean", {"trim": 0.13}), ("trimmed_mean", {"trim": 0.5}), ("lts", {"trim": 0.2}), ("lts", {"trim": 0.5, "lts_patience": 1}), ("lts", {"trim": 0.4, "lts_patience": 1000}),
])
def test_hot_groups(spark, obs, method, options, kind):
    table = obs.withColumn("y", F.col("y").cast(kind))
    of = lambda hot: {r["group_id"]: r["theta"] for r in location(table, method, 15, hot=hot, **options).collect()}
    whole, spread = of(1 << 18), of(30)
    assert whole.keys() == spread.keys() == set(range(15)) and whole[14] is None
    for g, x in whole.items():
        assert spread[g] == (pytest.approx(x, rel=1e-9, abs=1e-9) if x is not None else None), g


@pytest.mark.parametrize("before", [False, True])
def test_running_values_in_two_levels(spark, obs, before):
    got = running(in_parts(obs, "group_id", "y", 9), "group_id", "y", {"total": ("sum", F.lit(1)), "least": ("min", F.col("y")), "most": ("max", F.col("y"))}, before)
    rows = sorted(got.collect(), key=lambda r: (r["group_id"], r["total"] or 0))
    assert len({r["part_"] for r in rows if r["group_id"] == 0}) > 1
    seen = {}
    for r in rows:
        ys = seen.setdefault(r["group_id"], [])
        if not before:
            ys.append(r["y"])
        assert (r["total"] or 0) == len(ys) and r["least"] == (ys[0] if ys else None) and r["most"] == (ys[-1] if ys else None)
        if before:
            ys.append(r["y"])


def test_no_task_holds_a_hot_group(spark):
    """Of rows of one group and, mostly, of one value, every part gets its share, and the windows are by part or over parts."""
    obs = spark.range(9000).select(F.lit(0).cast("long").alias("group_id"), (F.col("id") % 10 == 0).cast("double").alias("y"))
    parts = in_parts(obs, "group_id", "y", 9)
    assert max(r["count"] for r in parts.groupBy("part_").count().collect()) < 2000
    plan = running(parts, "group_id", "y", {"s": ("sum", F.col("y"))})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert len(windows) == 2 and all("part_" in line for line in windows)
