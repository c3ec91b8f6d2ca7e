"""Checks that ride on the operator's own job, sums that no order changes, and streams that go on from a checkpoint."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fusewright.functions.schemas import pairs_from_array
from fusewright.operators.encoding import LabelEncoder
from fusewright.operators.group_stats import group_stats
from fusewright.operators.location import location
from fusewright.operators.pairs import canonicalize, guarded_pairs
from fusewright.streaming.incremental import stream_canonical_pairs, stream_encode


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("obs") / "t")
    spark.range(400).selectExpr("id AS obs_idx", "id % 7 AS group_id", "CAST(id % 13 AS DOUBLE) AS y", "id AS pair_idx", "id % 7 AS u", "id % 5 AS v", "CAST(1 + id % 3 AS DOUBLE) AS weight").write.parquet(path)
    return spark.read.parquet(path)


OPERATORS = {
    "stats": lambda df: group_stats(df, 9, validate="in plan"),
    "mean": lambda df: location(df, "mean", 9, validate="in plan"),
    "median": lambda df: location(df, "median", 9, validate="in plan", hot=None),
    "lts": lambda df: location(df, "lts", 9, validate="in plan", hot=None),
    "pairs": lambda df: guarded_pairs(df, 9, "sum"),
}
PLAIN = {
    "stats": lambda df: group_stats(df, 9), "mean": lambda df: location(df, "mean", 9), "median": lambda df: location(df, "median", 9), "lts": lambda df: location(df, "lts", 9), "pairs": lambda df: canonicalize(df, "sum"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_job_before_the_operators_own(spark, stored, name):
    spark.sparkContext.setJobGroup(f"own-{name}", "")
    made = OPERATORS[name](stored)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(f"own-{name}")) == []
    spark.sparkContext.setJobGroup("", "")
    plan = made._jdf.queryExecution().executedPlan().toString()
    # least trimmed squares reads its rows for the runs and for the groups of one or two
    assert plan.split("Initial Plan")[0].count("FileScan parquet") == (2 if name == "lts" else 1)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, PLAIN[name](stored).collect()))


@pytest.mark.parametrize(("name", "column", "value", "says"), [
    ("stats", "group_id", -1, "group_id must be non-negative"), ("stats", "group_id", 9, "group_id must be < 9"), ("stats", "group_id", None, "group_id is null"),
    ("mean", "y", None, "y is null"), ("median", "y", math.nan, "y must be finite"), ("lts", "y", -math.inf, "y must be finite"), ("median", "group_id", 11, "group_id must be < 9"),
    ("pairs", "v", 9, "v must be < 9"), ("pairs", "weight", 0.0, "weight must be positive"), ("pairs", "u", -3, "u must be non-negative"),
])
def test_a_bad_row_fails_the_job(stored, name, column, value, says):
    bad = stored.withColumn(column, F.when(F.col("obs_idx") == 137, F.lit(value)).otherwise(F.col(column)))
    with pytest.raises(Exception, match=says):
        OPERATORS[name](bad).collect()


def test_the_number_of_groups_must_be_known(stored):
    for call in (lambda: group_stats(stored, validate="in plan"), lambda: location(stored, "mean", validate="in plan")):
        with pytest.raises(ValueError, match="n_groups"):
            call()


@pytest.mark.parametrize("scale", [1.0, 1e300, 1e-300, 5e-324])
def test_sums_do_not_depend_on_order(spark, scale):
    rng = random.Random(str(scale))
    rows = [(k % 4, math.copysign(scale * 10.0 ** rng.uniform(0, 7 if scale < 1e-320 else -14), rng.random() - 0.5) if k % 5 else rng.choice([0.0, -0.0, scale])) for k in range(3000)]
    of = lambda part, shuffled: [tuple(r) for r in group_stats(spark.createDataFrame(shuffled, "group_id long, y double").repartition(part), 5, reproducible=True).orderBy("group_id").collect()]
    results = [of(part, rng.sample(rows, len(rows))) for part in (1, 3, 200)]
    assert results[0] == results[1] == results[2]
    for g, size, total, mean in results[0][:4]:
        ys = [y for k, y in rows if k == g]
        assert size == 750 and total == pytest.approx(math.fsum(ys), rel=1e-15, abs=sum(map(abs, ys)) * 2**-100) and mean == total / size
    assert results[0][4] == (4, 0, 0.0, 0.0)


def test_sums_of_no_rows_and_of_zeros(spark):
    zeros = spark.createDataFrame([(0, 0.0), (1, -0.0)], "group_id long, y double")
    assert [r["sum"] for r in group_stats(zeros, reproducible=True).orderBy("group_id").collect()] == [0.0, 0.0]
    assert group_stats(zeros.limit(0), reproducible=True).collect() == []


@pytest.mark.parametrize("how", ["first", "mean", "sum", "max", "min"])
def test_a_stream_of_pairs_goes_on_from_its_checkpoint(spark, tmp_path, how):
    rng = random.Random(how)
    batches = [[(100 - 40 * b + k, rng.randrange(5), rng.randrange(5), float(rng.randrange(1, 50))) for k in range(30)] for b in range(3)]  # later rows have lesser pair_idx
    schema, source, sink = "pair_idx long, u long, v long, weight double", str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        merged = stream_canonical_pairs(spark.readStream.schema(schema).parquet(source), how)
        # every query is a new one, which finds what was merged in the checkpoint alone
        q = merged.writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(sink)).start()
        q.awaitTermination(120)
        got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
        assert got == sorted(tuple(r) for r in canonicalize(spark.read.schema(schema).parquet(source), how).collect())
    assert got


def test_a_stream_is_encoded(spark, tmp_path):
    dictionary = LabelEncoder().fit(spark.createDataFrame([("b",), ("a",), ("c",)], "label string")).dictionary
    spark.createDataFrame([("c",), ("a",), ("x",)], "label string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("label string").parquet(str(tmp_path / "in"))
    found = []
    run = lambda df, k: df.writeStream.option("checkpointLocation", str(tmp_path / k)).trigger(availableNow=True).foreachBatch(lambda b, _: found.extend(tuple(r) for r in b.collect())).start().awaitTermination(120)
    run(stream_encode(stream, dictionary, strict=False), "loose")
    assert sorted(found, key=str) == [("a", 0), ("c", 2), ("x", None)]
    with pytest.raises(Exception, match="unknown label"):
        run(stream_encode(stream, dictionary), "strict")


def test_pairs_stay_as_they_were(spark):
    pairs = pairs_from_array(spark, [(0, 1), (1, 0), (2, 2)], [1.0, 5.0, 9.0])
    assert [tuple(r) for r in guarded_pairs(pairs, 3).collect()] == [(0, 1, 1.0)]
