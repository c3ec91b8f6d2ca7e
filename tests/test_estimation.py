"""Group statistics, locations, weights and the scalar problem on worked values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusewright.functions.schemas import obs_from_arrays, pairs_from_array, require
from fusewright.functions.storage import materialize, scope
from fusewright.functions.validation import check_array, check_groups
from fusewright.operators import location as loc
from fusewright.operators.group_stats import group_stats, grouping_flag
from fusewright.operators.location import location
from fusewright.operators.prox import compare_solvers, objective, solve_scalar, solve_scalar_bisection, solve_scalar_row, solve_scalar_small, weighted_median
from fusewright.operators.weights import adaptive_weights, distance_weights, uniform_weights
from fusewright.sources.tables import benchmark_problems


def stats(spark, y, g, n=None):
    return [tuple(r) for r in group_stats(obs_from_arrays(spark, y, g), n).orderBy("group_id").collect()]


def theta(spark, y, g, method, n=None, **options):
    return [r["theta"] for r in location(obs_from_arrays(spark, y, g), method, n, **options).orderBy("group_id").collect()]


def test_group_stats(spark):
    assert stats(spark, [1, 2, 3, 4], [0, 0, 1, 1]) == [(0, 2, 3.0, 1.5), (1, 2, 7.0, 3.5)]
    assert stats(spark, [10, 20], [0, 2]) == [(0, 1, 10.0, 10.0), (1, 0, 0.0, 0.0), (2, 1, 20.0, 20.0)]
    assert [r[1] for r in stats(spark, [5, 15], [1, 4])] == [0, 1, 0, 0, 1]
    assert [r[1] for r in stats(spark, [1, 2], [0, 1], 5)] == [1, 1, 0, 0, 0]
    for y, g, n in (([1], [-1], None), ([1, 2], [0, 2], 2), ([1], [0], 0)):
        with pytest.raises(ValueError):
            stats(spark, y, g, n)
    with pytest.raises(ValueError):
        obs_from_arrays(spark, [1.0], [0, 1])


def test_grouping_flag(spark):
    flag = lambda y, g: grouping_flag(obs_from_arrays(spark, y, g)).head()[0]
    assert flag([5, 6, 7], [0, 1, 2]) is False
    assert flag([5, 6, 7], [0, 2, 1]) is True
    assert grouping_flag(spark.createDataFrame([], "obs_idx long, group_id long")).head()[0] is False


@pytest.mark.parametrize(
    ("method", "options", "y", "expected"),
    [
        ("trimmed_mean", {"trim": 0.0}, [1, 2, 3, 4, 5], 3.0),
        ("trimmed_mean", {"trim": 0.2}, [1, 2, 3, 4, 100], 3.0),
        ("trimmed_mean", {"trim": 0.1}, [3, 7], 5.0),
        ("trimmed_mean", {"trim": 0.5}, [1, 2, 3, 10], 2.5),
        ("huber", {}, [1, 2, 3, 4, 5, 100], 3.5),
        ("huber", {}, [1, 2, 100], 2.1724999452),
        ("huber", {"tol": 0.5}, [1, 2, 100], 2.0),
        ("huber", {"max_iter": 0}, [1, 2, 100], 2.0),
        ("lts", {"trim": 0.2, "lts_patience": 10}, [1, 2, 3, 4, 5, 100], 3.0),
        ("lts", {"trim": 0.5, "lts_patience": 10}, [10, 11, 12, 100, 200, 300], 11.0),
        ("lts", {"trim": 0.2}, [-10, -5, -3, -2, -1], -2.75),
        ("lts", {"trim": 0.5, "lts_patience": 1}, [0, 1, 2, 3, 50, 90, 90.5, 91, 91.2, 91.3], 11.2),
        ("lts", {"trim": 0.5, "lts_patience": 5}, [0, 1, 2, 3, 50, 90, 90.5, 91, 91.2, 91.3], 90.8),
        ("median", {}, [1, 2, 5, 9], 3.5),
        ("MEAN", {}, [1, 2, 6], 3.0),
    ],
)
def test_locations(spark, method, options, y, expected):
    assert theta(spark, y, [0] * len(y), method, **options)[0] == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("method", ["mean", "median", "trimmed_mean", "huber", "lts"])
def test_constant_groups_and_empty_groups(spark, method):
    assert theta(spark, [3, 3, 3, 7, 7, 7], [0, 0, 0, 2, 2, 2], method, 4) == [3.0, None, 7.0, None]


def test_location_arguments(spark):
    for bad in ({"method": "mode"}, {"method": "lts", "trim": 0.6}):
        with pytest.raises(ValueError):
            theta(spark, [1, 2], [0, 0], **bad)
    with pytest.raises(ValueError):
        theta(spark, [1.0, math.nan], [0, 0], "mean")


@pytest.mark.parametrize("g, n, ok", [([0, 1, 2, 1, 0], None, 3), ([0, 2, 4], 5, 5), ([0, 2], None, 0), ([1, 2], None, 0), ([0, 5], 5, 0), ([1, 2], 5, 0), ([0, 1], -1, 0), ([0, 1, 2], 2, 0)])
def test_check_groups(spark, g, n, ok):
    obs = obs_from_arrays(spark, [0.0] * len(g), g)
    if ok:
        assert check_groups(obs, n) == ok
    else:
        with pytest.raises(ValueError):
            check_groups(obs, n)


def test_check_array_and_ids(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,)], "y double")
    check_array(df, "y", allow_nan=True)
    with pytest.raises(ValueError, match="finite"):
        check_array(df, "y")
    with pytest.raises(ValueError):
        require(spark.createDataFrame([("a",)], "u string"), "u")
    with pytest.raises(Exception, match="whole"):
        require(spark.createDataFrame([(1.5,)], "u double"), "u").collect()


def weights(df):
    return [r["weight"] for r in df.orderBy("u", "v").collect()]


def test_weights(spark):
    pairs = pairs_from_array(spark, [(0, 1), (1, 2)])
    at = lambda *t: spark.createDataFrame([(k, v) for k, v in enumerate(t)], "group_id long, theta double")
    assert weights(adaptive_weights(pairs, at(1.0, 5.0, 10.0))) == [0.25, 0.2]
    assert weights(distance_weights(pairs, at(1.0, 5.0, 10.0))) == [4.0, 5.0]
    assert weights(adaptive_weights(pairs, at(5.0, 5.0, 10.0)))[0] == 1e10
    for empty in (math.nan, None):
        assert weights(adaptive_weights(pairs, at(5.0, empty, 10.0)))[0] == 1.0
        assert weights(distance_weights(pairs, at(5.0, empty, 10.0)))[0] == 0.0
        assert weights(adaptive_weights(pairs, at(5.0, empty, 10.0), w_max=0.5))[0] == 0.5
    assert weights(adaptive_weights(pairs, at(1.0, 5.0, 10.0), 1.5)) == pytest.approx([4**-1.5, 5**-1.5])
    assert weights(uniform_weights(pairs, 2.5)) == [2.5, 2.5]
    for f in (lambda: adaptive_weights(pairs, at(1.0), 0), lambda: adaptive_weights(pairs, at(1.0), 1, 0), lambda: uniform_weights(pairs, -1), lambda: uniform_weights(pairs, math.inf)):
        with pytest.raises(ValueError):
            f()


PROBLEMS = [
    (10, 50, [], [], 1, 5), (10, 50, [3], [1], 1, 4.9), (10, 100, [3], [1], 1000, 3), (10, 50, [3, 7], [1, 1], 1, 5), (10, 50, [3, 7], [2, 1], 1, 4.9),
    (10, 50, [3, 7], [0, 0], 1, 5), (20, 100, [1, 5, 9], [2, 1, 1], 1.5, 5), (20, 100, [1, 5, 9], [2, 1, 100], 1.5, 9), (0, 0, [], [], 1, 0),
    (0, 0, [1, 5, 9], [1, 1, 1], 1, 5), (0, 0, [1, 5, 9], [2, 1, 1], 1, 1), (0, 0, [1, 5, 9], [0, 0, 0], 1, 5), (0, 0, [1, 5], [1, 1], 0, 1),
]


def problem_tables(spark, rows):
    problems = spark.createDataFrame([(k, float(n), float(s), float(lam)) for k, (n, s, _, _, lam, *_) in enumerate(rows)], "problem_id long, n double, s double, lam double")
    nbrs = spark.createDataFrame([(k, j, float(z), float(w)) for k, r in enumerate(rows) for j, (z, w) in enumerate(zip(r[2], r[3]))], "problem_id long, nbr long, z double, w double")
    return problems, nbrs


def test_scalar_worked_values(spark):
    tables = problem_tables(spark, PROBLEMS)
    for solved in (solve_scalar(*tables), solve_scalar(*tables, largest=3), solve_scalar_small(*tables)):
        got = {r["problem_id"]: r["x"] for r in solved.collect()}
        assert [got[k] for k in range(len(PROBLEMS))] == pytest.approx([p[-1] for p in PROBLEMS])


def test_scalar_is_optimal_and_forms_agree(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        r = rng.choice([0, 1, 2, 3, 5, 9])
        rows.append((rng.uniform(1, 20), rng.uniform(-50, 50), [rng.choice([-2.0, 0.0, 1.0, rng.uniform(-5, 5)]) for _ in range(r)], [rng.choice([0.0, rng.uniform(0.5, 2)]) for _ in range(r)], rng.choice([0, 0.5, 2, 20])))
    problems, nbrs = problem_tables(spark, rows)
    solved = solve_scalar(problems, nbrs)
    best = {r["problem_id"]: r["objective"] for r in objective(solved, problems, nbrs).collect()}
    lists = nbrs.groupBy("problem_id").agg(F.collect_list(F.struct("z", "w")).alias("nbrs"))
    local = problems.join(lists, "problem_id", "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast("array<struct<z:double,w:double>>")))
    x2 = {r["problem_id"]: r["x"] for r in local.select("problem_id", solve_scalar_row(F.col("n"), F.col("s"), F.col("lam"), F.col("nbrs")).alias("x")).collect()}
    for r in solved.collect():
        n, s, z, w, lam = rows[r["problem_id"]]
        cost = lambda x: n * x * x / 2 - s * x + lam * sum(b * abs(x - a) for a, b in zip(z, w))  # noqa: B023, E731
        assert best[r["problem_id"]] == pytest.approx(cost(r["x"]))
        assert x2[r["problem_id"]] == pytest.approx(r["x"])
        for step in (1e-4, -1e-4, 0.1, -0.1):
            assert cost(r["x"]) <= cost(r["x"] + step) + 1e-9


def test_bisection_agrees(spark):
    problems, nbrs = problem_tables(spark, PROBLEMS)
    got = {r["problem_id"]: r["x"] for r in solve_scalar_bisection(problems.filter("n > 0"), nbrs).collect()}
    assert [got[k] for k in sorted(got)] == pytest.approx([p[-1] for p in PROBLEMS if p[0]], abs=1e-9)
    rates = compare_solvers(*problem_tables(spark, [p for p in PROBLEMS if p[0]])).collect()
    assert {r["r"]: (r["problems"], r["solved"]) for r in rates} == {0: (1, 1), 1: (2, 2), 2: (3, 3), 3: (2, 2)}


def test_small_problems_are_small(spark):
    with pytest.raises(Exception, match="over 64 neighbours"):
        solve_scalar_small(*problem_tables(spark, [(1, 1, [1.0] * 65, [1.0] * 65, 1)])).collect()


def test_scalar_rejects(spark):
    for row in ((1, 1, [], [], -1), (-1, 1, [], [], 1), (1, 1, [1], [-1], 1)):
        with pytest.raises(ValueError):
            solve_scalar(*problem_tables(spark, [row]))


def test_weighted_median(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 5.0, 1.0), (0, 9.0, 1.0), (1, 1.0, 0.0), (1, 2.0, 0.0)], "key long, z double, w double")
    assert {r["key"]: r["x"] for r in weighted_median(df).collect()} == {0: 1.0, 1: 2.0}


def test_huber_by_blocks_and_by_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, k % 5 if k < 200 else 5, float(v)) for k, v in enumerate(np.round(rng.standard_t(2, 260) * 10, 1))] + [(300, 6, 4.0), (301, 6, 8.0), (302, 8, 1.0)]
    obs = spark.createDataFrame(rows, "obs_idx long, group_id long, y double")
    results = []
    for block, cells in ((1 << 16, 1 << 20), (8, 1 << 20), (1 << 16, 16)):
        monkeypatch.setattr(loc, "BLOCK", block)
        monkeypatch.setattr(loc, "CELLS", cells)
        results.append({r["group_id"]: (r["theta"], r["converged"]) for r in loc.huber_report(obs, 5.0, 40, 1e-4).collect()})
    for g in range(6):
        y = np.sort([v for _, k, v in rows if k == g])
        t, done = np.median(y), False
        for _ in range(40):
            w = np.minimum(1, 5.0 / np.maximum(np.abs(y - t), 1e-300))
            new = (w * y).sum() / w.sum()
            done = abs(new - t) < 1e-4
            if done:
                break
            t = new
        assert all(r[g][1] == done and abs(r[g][0] - t) < 1e-6 for r in results)
    assert all(r[6] == (6.0, True) and r[8] == (1.0, True) and 7 not in r for r in results)


def test_tables_last_as_long_as_their_scope(spark):
    table = spark.range(3)
    with scope(spark) as keep:
        kept = keep(materialize(table))
        with scope(spark):
            inner = materialize(table)
        with pytest.raises(Exception, match="exist"):
            inner.count()
        gone = materialize(table)
    assert kept.count() == 3
    with pytest.raises(Exception, match="exist"):
        gone.count()


def test_generated_neighbours_are_not_taken_for_a_small_table(spark):
    """The optimiser broadcasts what it believes to be small: no fewer bytes than the neighbours' numbers have."""
    problems, nbrs = benchmark_problems(spark, ids=spark.range(1200))
    rows = 200 * (5 + 20 + 50 + 100 + 200 + 500)
    assert nbrs.count() == rows and nbrs.dropDuplicates(["problem_id", "nbr"]).filter("nbr >= 0").count() == rows
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(nbrs) >= 32 * rows and size(problems) < 1 << 18


def test_solutions_are_computed_once(spark):
    """Each step of bisection adds up the neighbours once, and its result is read once for the objective."""
    problems, nbrs = benchmark_problems(spark, per_size=1)
    plan = objective(solve_scalar_bisection(problems, nbrs), problems, nbrs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("SIGNUM") == 1
    rates = {r["r"]: (r["problems"], r["solved"]) for r in compare_solvers(problems, nbrs).collect()}
    assert rates == dict.fromkeys((5, 20, 50, 100, 200, 500), (1, 1))
