"""Location of each group: mean, median, trimmed mean, Huber's M-estimate, least trimmed squares.

No group is held in an array or map. Groups of at most ``HOT`` rows are ranked in windows, which spill: median, trimmed mean and least trimmed
squares after one shuffle by group. A larger group is spread over tasks: the median and the trimmed mean select the
values at their two ranks by rounds of counting (``selection.py``) and sum what lies between, a partial aggregation; least trimmed squares takes ranks
and running sums in two levels, parts of a group and offsets of the parts, joins both ends of its runs by rank and finds the best so far in two levels again.
Groups of one or two rows have their mean.

Huber first counts equal values of a group, a partial aggregation that spreads a hot group over all tasks.
Its reweighting has no closed form. Its values are dealt in blocks of ``BLOCK`` distinct ones. A group of one block is
solved where it is, with others like it, in NumPy over Arrow batches; a larger one takes a round over its blocks for each step, whose sums are added, until it converges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusewright.functions.ordering import in_parts, running
from fusewright.functions.schemas import require, spine
from fusewright.functions.shipping import ship
from fusewright.functions.storage import materialize
from fusewright.functions.validation import IN_PLAN, METHODS, choice, fraction, guard, raise_first, settle_groups, survey, violations
from fusewright.operators.selection import crossings

BLOCK = 1 << 16
#: Rows of a group from which it is spread over tasks.
HOT = 1 << 18
#: Values in a matrix of groups that are solved together.
CELLS = 1 << 20


def _mean(obs: DataFrame) -> DataFrame:
    return obs.groupBy("group_id").agg((F.sum("y").cast("double") / F.count("*")).alias("theta"))


def _kept_ranks(trim: float) -> tuple[Column, Column]:
    """Ranks low + 1 to high count, of n: all of one or two, the middle if trimming leaves nothing, else all but the cut ends."""
    n, cut = F.col("n"), F.floor(F.lit(trim) * F.col("n")).cast("long")
    low = F.when(n <= 2, 0).when(2 * cut >= n, F.expr("(n + 1) div 2 - 1")).otherwise(cut)
    high = F.when(n <= 2, n).when(2 * cut >= n, F.expr("(n + 2) div 2")).otherwise(n - cut)
    return low.cast("long"), high.cast("long")


def _trimmed(obs: DataFrame, trim: float) -> DataFrame:
    """The mean of the kept ranks. The median is what trimming half of each end leaves, the mean of the middle one or two."""
    w = Window.partitionBy("group_id")
    low, high = _kept_ranks(trim)
    ranks = obs.withColumns({"k": F.row_number().over(w.orderBy("y")), "n": F.count("*").over(w)})
    return ranks.filter((F.col("k") > low) & (F.col("k") <= high)).groupBy("group_id").agg((F.sum("y").cast("double") / F.count("*")).alias("theta"))


def _large_trimmed(obs: DataFrame, trim: float, hot: int) -> DataFrame:
    """The same for large groups, without ranks: the values at the ends of what is kept, and the sum of what lies between."""
    low, high = _kept_ranks(trim)
    ranks = obs.groupBy("group_id").agg(F.count("*").alias("n")).select("group_id", low.alias("low"), high.alias("high"))
    ends = F.array(F.struct(F.lit(0).alias("t"), (F.col("low") + 1).alias("rank")), F.struct(F.lit(1).alias("t"), F.col("high").alias("rank")))
    targets = ranks.select("group_id", F.explode(ends).alias("x")).select("group_id", "x.*")
    values = obs.select("group_id", F.col("y").alias("z"), F.lit(0).alias("tie"), F.lit(1).cast("long").alias("w"))
    at = crossings(values, targets, "group_id", lambda z, upto: upto >= F.col("rank"), hot)
    first, last = (at.filter(F.col("t") == t).select("group_id", F.col("z").alias(name), F.col("rank").alias(f"{name}_rank")) for t, name in enumerate(("first", "last")))
    y, below, at_first, at_last = F.col("y"), F.col("y") < F.col("first"), F.col("y") == F.col("first"), F.col("y") == F.col("last")
    sums = obs.join(first.join(last, "group_id"), "group_id").groupBy("group_id", "first", "last", "first_rank", "last_rank").agg(
        F.count_if(below).alias("under"), F.count_if(below | at_first).alias("through"), F.count_if(y < F.col("last")).alias("under_last"),
        F.sum(F.when(~below & ~at_first & ~at_last & (y < F.col("last")), y)).alias("between"), F.count_if(at_last).alias("equal"),
    )
    kept = F.col("last_rank") - F.col("first_rank") + 1
    of_first = (F.col("through") - F.col("first_rank") + 1).cast("int")
    of_last = (F.col("last_rank") - F.col("under_last")).cast("int")
    total = (F.coalesce("between", F.lit(0)) + F.col("first") * of_first + F.col("last") * of_last).cast("double")
    return sums.select("group_id", F.when(F.col("first") == F.col("last"), F.col("first").cast("double")).otherwise(total / kept).alias("theta"))


def _counted(obs: DataFrame) -> DataFrame:
    """group_id, y, k (rows with that value), upto (rows up to it) and n (rows of the group)."""
    w = Window.partitionBy("group_id")
    values = obs.groupBy("group_id", "y").agg(F.count("*").alias("k"))
    return values.withColumns({"upto": F.sum("k").over(w.orderBy("y").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(w)})


def _weights(y: np.ndarray, k: np.ndarray, t: np.ndarray, delta: float) -> np.ndarray:
    """Weights of values that occur ``k`` times, around ``t``."""
    r = np.abs(y - t)
    return np.where(r <= delta, k, k * (delta / np.where(r > delta, r, 1.0)))


def _steps(y: np.ndarray, k: np.ndarray, t: np.ndarray, delta: float, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and whether they converged. y, k: (values, groups), k is 0 below a group's values; sums run down the columns in order."""
    t, done = t.copy(), np.zeros(len(t), bool)
    for _ in range(max_iter):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        w = _weights(y[:, at], k[:, at], t[at], delta)
        new = (w * y[:, at]).sum(0) / w.sum(0)
        done[at] = np.abs(new - t[at]) < tol
        t[at] = np.where(done[at], t[at], new)  # on convergence the estimate before the last step is the result
    return t, done


def _whole_groups(batches: Iterator[pa.RecordBatch], solve: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``solve`` of group_id, y, k and start in slices of whole groups; the batches are sorted by group."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        part = tuple(batch.column(c).to_numpy() for c in ("group_id", "y", "k", "start"))
        if not len(part[0]):
            continue
        cut = int(np.searchsorted(part[0], part[0][-1]))  # the last group may go on
        if held and (cut or held[-1][0][-1] != part[0][0]):
            held.append(tuple(c[:cut] for c in part))
            size += cut
            part = tuple(c[cut:] for c in part)
            if size >= CELLS:
                yield solve(*(np.concatenate(c) for c in zip(*held)))
                held, size = [], 0
        held.append(part)
        size += len(part[0])
    if held:
        yield solve(*(np.concatenate(c) for c in zip(*held)))


def _huber(obs: DataFrame, delta: float, max_iter: int, tol: float) -> DataFrame:
    """group_id, theta and converged: reweighting from the median."""
    spark = obs.sparkSession
    ship(spark)
    middle = _counted(obs).withColumns({"low": F.expr("(n + 1) div 2"), "high": F.expr("(n + 2) div 2")})
    covers = F.greatest(F.lit(0), F.least("high", "upto") - F.greatest(F.col("low") - 1, F.col("upto") - F.col("k")))
    w = Window.partitionBy("group_id")
    y = F.col("y").cast("double")
    start = F.sum(y * covers).over(w) / F.sum(covers).over(w)
    values = middle.select("group_id", y.alias("y"), F.col("k").cast("double").alias("k"), "n", start.alias("start"), F.floor((F.row_number().over(w.orderBy("y")) - 1) / BLOCK).alias("block"), F.count("*").over(w).alias("distinct"))
    values = materialize(values.filter("n > 2"), "values")
    few = obs.groupBy("group_id").agg((F.sum("y").cast("double") / F.count("*")).alias("theta"), F.count("*").alias("n")).filter("n <= 2").select("group_id", "theta", F.lit(True).alias("converged"))

    def solve(group: np.ndarray, y: np.ndarray, k: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(first, len(group)))
        theta, done = np.empty(len(first)), np.empty(len(first), bool)
        order = np.argsort(sizes, kind="stable")
        while len(order):
            # groups of alike sizes, so that little of the matrix is empty
            most = min(len(order), max(1, CELLS // max(1, 2 * int(sizes[order[0]]))))
            some = order[:most][sizes[order[:most]] <= 2 * sizes[order[0]]]
            order = order[len(some) :]
            row = np.concatenate([np.arange(n) for n in sizes[some]])
            column, at = np.repeat(np.arange(len(some)), sizes[some]), np.repeat(first[some], sizes[some]) + row
            ys, ks = (np.zeros((int(sizes[some].max()), len(some))) for _ in range(2))
            ys[row, column], ks[row, column] = y[at], k[at]
            theta[some], done[some] = _steps(ys, ks, start[first[some]], delta, max_iter, tol)
        return pa.RecordBatch.from_arrays([pa.array(group[first]), pa.array(theta), pa.array(done)], ["group_id", "theta", "converged"])

    one_block = values.filter(F.col("distinct") <= BLOCK).select("group_id", "y", "k", "start").repartition("group_id").sortWithinPartitions("group_id", "y")
    solved = one_block.mapInArrow(lambda batches: _whole_groups(batches, solve), "group_id long, theta double, converged boolean")
    return few.unionByName(solved).unionByName(_large_huber(values.filter(F.col("distinct") > BLOCK), delta, max_iter, tol))


def _large_huber(values: DataFrame, delta: float, max_iter: int, tol: float) -> DataFrame:
    """The same for groups of several blocks, a round over all blocks for each step."""
    at = materialize(values.select("group_id", F.col("start").alias("t")).distinct(), "estimates")
    result = at.select("group_id", F.col("t").alias("theta"), F.lit(False).alias("converged")).limit(0)
    for _ in range(max_iter):
        if at.isEmpty():
            break
        r = F.abs(F.col("y") - F.col("t"))
        weight = F.when(r <= delta, F.col("k")).otherwise(F.col("k") * (F.lit(delta) / F.when(r > delta, r)))
        blocks = values.join(at, "group_id").groupBy("group_id", "block", "t").agg(F.sum(weight).alias("w"), F.sum(weight * F.col("y")).alias("wy"))
        moved = blocks.groupBy("group_id", "t").agg((F.sum("wy") / F.sum("w")).alias("new"))
        moved = materialize(moved, "moved")
        near = F.abs(F.col("new") - F.col("t")) < tol
        result = result.unionByName(moved.filter(near).select("group_id", F.col("t").alias("theta"), F.lit(True).alias("converged")))
        at = moved.filter(~near).select("group_id", F.col("new").alias("t"))
    return result.unionByName(at.select("group_id", F.col("t").alias("theta"), F.lit(False).alias("converged")))


def huber_report(obs: DataFrame, delta: float = 1.345, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """group_id, theta and converged: whether the last step of a group was below ``tol``."""
    return _huber(require(obs, "group_id", "y"), delta, max_iter, tol)


def _lts(obs: DataFrame, trim: float, patience: int, tol: float) -> DataFrame:
    """The mean of the best run of h sorted values; runs are looked at in order until ``patience`` in a row are no better by ``tol`` than the best before."""
    w = Window.partitionBy("group_id")
    order = w.orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    h = F.greatest(F.lit(1), F.least(F.ceil((F.lit(1.0) - F.lit(trim)) * F.col("n")).cast("long"), F.col("n")))
    sums = obs.select("group_id", F.row_number().over(w.orderBy("y")).alias("rn"), F.count("*").over(w).alias("n"), F.sum("y").over(order).cast("double").alias("s1"), F.sum(F.col("y") * F.col("y")).over(order).cast("double").alias("s2"))
    # each row twice, as the end of the run that starts after place rn - h and as what comes before the run after place rn, so that the two meet without a join
    ends = F.array(F.struct(F.col("rn").alias("k"), F.lit(0).alias("end")), F.struct((F.col("rn") - F.col("h")).alias("k"), F.lit(1).alias("end")))
    marks = sums.withColumn("h", h).select("group_id", "n", "h", "s1", "s2", F.explode(ends).alias("m")).select("group_id", "n", "h", "s1", "s2", "m.k", "m.end").filter("k >= 0")
    upto = w.orderBy("k", "end").rowsBetween(Window.unboundedPreceding, 0)
    begin = lambda c: F.coalesce(F.last(F.when(F.col("end") == 0, F.col(c)), ignorenulls=True).over(upto), F.lit(0.0))
    runs = marks.withColumns({"t1": F.col("s1") - begin("s1"), "t2": F.col("s2") - begin("s2")}).filter("end = 1")
    runs = runs.select("group_id", "k", "n", (F.col("t2") - F.col("t1") * F.col("t1") / F.col("h")).alias("sse"), (F.col("t1") / F.col("h")).alias("mean"))
    before = w.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("sse").over(before)
    better = runs.withColumn("best", best).filter(F.col("best").isNull() | (F.col("sse") < F.col("best") - tol))
    late = F.col("k") - F.lag("k").over(w.orderBy("k")) > patience
    reached = better.withColumn("stopped", F.max(late).over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))).filter("stopped IS NULL OR NOT stopped")
    means = obs.groupBy("group_id").agg((F.sum("y").cast("double") / F.count("*")).alias("mean"), F.count("*").alias("n"))
    last = reached.groupBy("group_id").agg(F.max_by("mean", "k").alias("best"))
    return means.join(last, "group_id").select("group_id", F.when(F.col("n") <= 2, F.col("mean")).otherwise(F.col("best")).alias("theta"))


def _large_lts(obs: DataFrame, trim: float, patience: int, tol: float) -> DataFrame:
    """The same for large groups: no window over a group, but for a row for each of its parts."""
    parts = in_parts(obs.select("group_id", "y"), "group_id", "y")
    sums = running(parts, "group_id", "y", {"rn": ("sum", F.lit(1).cast("long")), "s1": ("sum", F.col("y")), "s2": ("sum", F.col("y") * F.col("y"))})
    n = parts.groupBy("group_id").agg(F.count("*").alias("n"))
    h = F.greatest(F.lit(1), F.least(F.ceil((F.lit(1.0) - F.lit(trim)) * F.col("n")).cast("long"), F.col("n")))
    sums = materialize(sums.select("group_id", "rn", F.col("s1").cast("double").alias("s1"), F.col("s2").cast("double").alias("s2")), "sums")
    ends = sums.join(n.select("group_id", h.alias("h")), "group_id").filter("rn >= h").select("group_id", (F.col("rn") - F.col("h")).alias("k"), "h", "s1", "s2")
    begins = sums.select("group_id", F.col("rn").alias("k"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    t1, t2 = (F.col(f"s{x}") - F.coalesce(f"b{x}", F.lit(0.0)) for x in (1, 2))
    runs = ends.join(begins, ["group_id", "k"], "left").select("group_id", "k", (t2 - t1 * t1 / F.col("h")).alias("sse"), (t1 / F.col("h")).alias("mean"))
    runs = running(in_parts(runs, "group_id", "k"), "group_id", "k", {"best": ("min", F.col("sse"))}, before=True)
    better = materialize(runs.filter(F.col("best").isNull() | (F.col("sse") < F.col("best") - tol)).drop("best"), "better")
    late = running(better, "group_id", "k", {"last": ("max", F.col("k"))}, before=True)
    stop = late.filter(F.col("k") - F.col("last") > patience).groupBy("group_id").agg(F.min("k").alias("stop"))
    reached = better.join(stop, "group_id", "left").filter(F.col("stop").isNull() | (F.col("k") < F.col("stop")))
    return reached.groupBy("group_id").agg(F.max_by("mean", "k").alias("theta"))


def location(
    obs: DataFrame, method: str = "mean", n_groups: int | None = None, *, trim: float = 0.1, huber_delta: float = 1.345, max_iter: int = 100, tol: float = 1e-6,
    lts_patience: int = 5, lts_tol: float = 1e-12, validate: bool | str = True, hot: int | None = HOT,
) -> DataFrame:
    """group_id and theta of every group from 0 to ``n_groups`` - 1; null for a group without rows. Groups of over ``hot`` rows are spread over tasks; None: there are none.

    validate: ``IN_PLAN`` with ``n_groups`` makes a bad row an error of the job that reads the rows; with ``hot`` None no job runs before it.
    """
    method, trim = choice(method, METHODS, "method"), fraction(trim)
    obs = require(obs, "group_id", "y")
    trim = 0.5 if method == "median" else trim
    ranked = method in ("median", "trimmed_mean", "lts") and hot is not None
    if validate == IN_PLAN:
        if n_groups is None:
            raise ValueError("n_groups must be given where rows are validated in the plan")
        obs, validate = guard(guard(obs, "y"), "group_id", non_negative=True, upper=n_groups, inclusive=False), False
    if validate or n_groups is None or ranked:
        # one job for all that has to be known before the plan: whether the rows are sound, how many groups, how large the largest
        known = survey(obs, violations("y") if validate else {})
        if validate:
            raise_first(known)
            n_groups = settle_groups(known, n_groups)
        elif n_groups is None:
            n_groups = 0 if known["max_id"] is None else known["max_id"] + 1
    spread = ranked and (known["largest"] or 0) > hot
    if spread:
        sizes = materialize(obs.groupBy("group_id").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("group_id"), "hot")
        few, many = obs.join(sizes, "group_id", "left_anti"), obs.join(sizes, "group_id", "left_semi")
    else:
        few, many = obs, None
    theta = {
        "mean": lambda: _mean(obs), "median": lambda: _trimmed(few, trim), "trimmed_mean": lambda: _trimmed(few, trim),
        "huber": lambda: _huber(obs, huber_delta, max_iter, tol), "lts": lambda: _lts(few, trim, lts_patience, lts_tol),
    }[method]().select("group_id", "theta")
    if spread:
        theta = theta.unionByName(_large_lts(many, trim, lts_patience, lts_tol) if method == "lts" else _large_trimmed(many, trim, hot))
    return spine(obs.sparkSession, n_groups).join(theta, "group_id", "left")
