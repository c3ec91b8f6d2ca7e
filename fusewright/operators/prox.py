"""The scalar problem: minimise n/2 x**2 - s x + lam * sum w |x - z| for every row of a table at once.

With the neighbours sorted by z, cw their running weights and W the total, the minimiser is the
median of all z and all (s - lam (2 cw_k - W)) / n for k = 0 to r, as the former rise and the latter fall: of the first z that is not
below its own (s - lam (2 cw_k - W)) / n and the one of k - 1, the smaller. For n = 0 it is
the lower weighted median of z, whatever lam; without weights the upper middle z; without neighbours 0.

Which z is first is a selection (``selection.py``), so a hub's neighbours are counted where they are and never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.functions.schemas import require
from fusewright.functions.validation import check, violations
from fusewright.operators.selection import LEAF, crossings

#: Largest number of neighbours for the row-local form, whose running weights cost the square of it.
ROW_LOCAL = 64
#: And for bisection, whose every step adds them up.
BISECTION_NEIGHBOURS = 4096


def check_problems(problems: DataFrame, nbrs: DataFrame) -> None:
    """n, lam and w finite and non-negative, s and z finite, every neighbour of a known problem."""
    check(problems, violations("n", non_negative=True) | violations("lam", non_negative=True) | violations("s"))
    check(nbrs, violations("z") | violations("w", non_negative=True))
    if not nbrs.join(problems, "problem_id", "left_anti").isEmpty():
        raise ValueError("there are neighbours of unknown problems")


def _median_targets(values: DataFrame, key: str) -> DataFrame:
    """key, t, total and r: the weight and number of the values."""
    return values.groupBy(key).agg(F.sum("w").alias("total"), F.count("*").alias("r")).withColumn("t", F.lit(0))


def _is_median(cw: Column) -> Column:
    """Whether the running weight reaches half; of values without weight, the running number the upper middle."""
    return F.when(F.col("total") > 0, cw >= F.col("total") / 2).otherwise(cw >= F.floor(F.col("r") / 2) + 1)


def solve_scalar(problems: DataFrame, nbrs: DataFrame, validate: bool = True, leaf: int = LEAF, largest: int | None = None) -> DataFrame:
    """problem_id and x. Problems of over ``leaf`` neighbours are narrowed by counting before anything is sorted.

    largest: a bound of a problem's neighbours, if known (2 on a chain); no job then has to look for hubs.
    """
    problems, nbrs = require(problems, "problem_id", "n", "s", "lam"), require(nbrs, "problem_id", "nbr", "z", "w")
    if validate:
        check_problems(problems, nbrs)
    sums = _median_targets(nbrs, "problem_id")
    targets = problems.join(sums, "problem_id", "left").withColumns({"t": F.lit(0), "total": F.coalesce("total", F.lit(0.0)), "r": F.coalesce("r", F.lit(0))})
    at = lambda cw: (F.col("s") - F.col("lam") * (2 * cw - F.col("total"))) / F.when(F.col("n") > 0, F.col("n"))
    holds = lambda z, cw: F.when(F.col("n") > 0, at(cw) <= z).otherwise(_is_median(cw))
    # values without weight count as one each where a weighted median is asked for
    weight = F.when((F.col("n") == 0) & (F.col("total") == 0), 1.0).otherwise(F.col("w"))
    first = crossings(nbrs.select("problem_id", "z", F.col("nbr").alias("tie"), "w"), targets, "problem_id", holds, leaf, largest, weight)
    smooth = F.when(F.col("z").isNull(), at(F.col("total"))).otherwise(F.least(F.col("z"), at(F.col("before"))))
    return first.select("problem_id", F.when(F.col("n") > 0, smooth).otherwise(F.coalesce("z", F.lit(0.0))).alias("x"))


def solve_scalar_small(problems: DataFrame, nbrs: DataFrame) -> DataFrame:
    """problem_id and x of problems of at most ``ROW_LOCAL`` neighbours, each solved in its row after one aggregation; more are an error of the job."""
    problems, nbrs = require(problems, "problem_id", "n", "s", "lam"), require(nbrs, "problem_id", "nbr", "z", "w")
    few = F.assert_true(F.count("*") <= ROW_LOCAL, F.lit(f"a problem has over {ROW_LOCAL} neighbours")).isNull()
    lists = nbrs.groupBy("problem_id").agg(F.when(few, F.collect_list(F.struct("z", "w"))).alias("nbrs"))
    rows = problems.join(lists, "problem_id", "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast("array<struct<z:double,w:double>>")))
    ordered, size = F.array_sort("nbrs"), F.size("nbrs")
    total = F.aggregate("nbrs", F.lit(0.0), lambda a, e: a + e["w"])
    # the running weights below half of the whole, or the lower half of the values if none has weight
    under = F.aggregate(ordered, F.struct(F.lit(0.0).alias("cw"), F.lit(0).alias("k")), lambda a, e: F.struct((a["cw"] + e["w"]).alias("cw"), (a["k"] + (a["cw"] + e["w"] < total / 2).cast("int")).alias("k")))["k"]
    flat = F.coalesce(F.get(ordered, F.when(total > 0, under).otherwise(F.floor(size / 2).cast("int")))["z"], F.lit(0.0))
    smooth = solve_scalar_row(F.when(F.col("n") > 0, F.col("n")), F.col("s"), F.col("lam"), F.col("nbrs"))
    return rows.select("problem_id", F.when(F.col("n") > 0, smooth).otherwise(flat).alias("x"))


def solve_scalar_bisection(problems: DataFrame, nbrs: DataFrame, steps: int = 200) -> DataFrame:
    """problem_id and x by halving the interval in which the subgradient changes sign, ``steps`` times: a second solver to compare with, of problems of at most ``BISECTION_NEIGHBOURS`` neighbours."""
    problems, nbrs = require(problems, "problem_id", "n", "s", "lam"), require(nbrs, "problem_id", "nbr", "z", "w")
    few = F.assert_true(F.count("*") <= BISECTION_NEIGHBOURS, F.lit(f"a problem has over {BISECTION_NEIGHBOURS} neighbours")).isNull()
    lists = nbrs.groupBy("problem_id").agg(F.when(few, F.collect_list(F.struct("z", "w"))).alias("nbrs"), F.min("z").alias("low"), F.max("z").alias("high"), F.sum("w").alias("total"))
    rows = problems.join(lists, "problem_id", "left").withColumns({"nbrs": F.coalesce("nbrs", F.array().cast("array<struct<z:double,w:double>>")), "total": F.coalesce("total", F.lit(0.0))})
    n = F.when(F.col("n") > 0, F.col("n"))
    ends = [F.least("low", (F.col("s") - F.col("lam") * F.col("total")) / n), F.greatest("high", (F.col("s") + F.col("lam") * F.col("total")) / n)]
    start = F.struct(F.coalesce(ends[0], F.lit(0.0)).alias("a"), F.coalesce(ends[1], F.lit(0.0)).alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        mid = acc["a"] / 2 + acc["b"] / 2
        pull = F.aggregate("nbrs", F.lit(0.0), lambda t, e: t + e["w"] * F.signum(mid - e["z"]))
        falls = F.col("n") * mid - F.col("s") + F.when(F.col("n") > 0, F.col("lam")).otherwise(1.0) * pull < 0
        # the neighbours are added up once a step, and no more when no number is left between the ends
        still = (mid > acc["a"]) & (mid < acc["b"])
        return F.when(~still, acc).when(falls, F.struct(mid.alias("a"), acc["b"].alias("b"))).otherwise(F.struct(acc["a"].alias("a"), mid.alias("b")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)
    return rows.withColumn("x", found).select("problem_id", (F.col("x.a") / 2 + F.col("x.b") / 2).alias("x"))


def compare_solvers(problems: DataFrame, nbrs: DataFrame, tol: float = 1e-9) -> DataFrame:
    """r (neighbours), problems, solved (how many the closed form solves to an objective no worse than bisection's, by ``tol`` of its size) and objective (their sum), for each number of neighbours."""
    closed, halved = (objective(f(problems, nbrs), problems, nbrs).withColumnRenamed("objective", c) for f, c in ((lambda p, q: solve_scalar(p, q, validate=False), "closed"), (solve_scalar_bisection, "halved")))
    sizes = nbrs.groupBy("problem_id").agg(F.count("*").alias("r"))
    both = closed.join(halved, "problem_id").join(sizes, "problem_id", "left").withColumn("r", F.coalesce("r", F.lit(0)))
    good = F.col("closed") <= F.col("halved") + tol * (1 + F.abs("halved"))
    return both.groupBy("r").agg(F.count("*").alias("problems"), F.count_if(good).alias("solved"), F.sum("closed").alias("objective"))


def solve_scalar_row(n: Column, s: Column, lam: Column, nbrs: Column) -> Column:
    """The same for one row with n > 0 and an array of (z, w) of at most ``ROW_LOCAL`` neighbours."""
    ordered = F.array_sort(nbrs)
    total = F.aggregate(nbrs, F.lit(0.0), lambda a, e: a + e["w"])
    sums = F.aggregate(ordered, F.array(F.lit(0.0)), lambda a, e: F.concat(a, F.array(F.element_at(a, -1) + e["w"])))
    points = F.transform(sums, lambda cw: (s - lam * (2 * cw - total)) / n)
    return F.element_at(F.array_sort(F.concat(F.transform(nbrs, lambda e: e["z"]), points)), F.size(nbrs) + 1)


def objective(solved: DataFrame, problems: DataFrame, nbrs: DataFrame) -> DataFrame:
    """problem_id and objective at ``solved``'s x."""
    at = problems.join(solved, "problem_id").select("problem_id", "n", "s", "lam", "x")  # read once, as it may be costly
    pulls = at.join(nbrs.select("problem_id", "z", "w"), "problem_id", "left").groupBy(*at.columns).agg(F.sum(F.col("w") * F.abs(F.col("x") - F.col("z"))).alias("pull"))
    value = F.col("n") * F.col("x") * F.col("x") / 2 - F.col("s") * F.col("x") + F.col("lam") * F.coalesce("pull", F.lit(0.0))
    return pulls.select("problem_id", value.alias("objective"))


def weighted_median(values: DataFrame, leaf: int = LEAF) -> DataFrame:
    """key and x of rows (key, z, w): the least z whose running weight reaches half; without weights the upper middle z."""
    targets = _median_targets(values, "key")
    weighed = values.select("key", "z", F.col("w").alias("tie"), F.col("w").cast("double").alias("w"))
    weight = F.when(F.col("total") == 0, 1.0).otherwise(F.col("w"))
    return crossings(weighed, targets, "key", lambda z, cw: _is_median(cw), leaf, weight=weight).select("key", F.col("z").alias("x"))


def graph_problems(stats: DataFrame, adjacency: DataFrame, theta: DataFrame, lam: float) -> tuple[DataFrame, DataFrame]:
    """One problem per node: its size and sum, and its neighbours at their current estimates."""
    problems = stats.select(F.col("group_id").alias("problem_id"), F.col("size").cast("double").alias("n"), F.col("sum").alias("s"), F.lit(float(lam)).alias("lam"))
    at = theta.select(F.col("group_id").alias("nbr"), F.col("theta").alias("z"))
    return problems, adjacency.join(at, "nbr").select(F.col("node").alias("problem_id"), "nbr", "z", F.col("weight").alias("w"))
