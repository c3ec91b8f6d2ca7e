"""Selection in groups of any size: the first value, in order, at which the running weight meets a condition.

Ranks, weighted medians and the scalar problem all ask for it: with the rows of a key sorted by z, the first z at which
``holds(z, weight up to it)`` is true, where the condition stays true from there on.

A key of at most ``LEAF`` rows is sorted in a window. The values of a larger one are narrowed first, all such keys together, in rounds over its
own rows: they are counted in ``BUCKETS`` equal parts of their range (a partial aggregation, so a key's rows are counted wherever they are),
the running weight over the parts tells which holds the answer, and its rows alone go on, until they are few or one value.
Where equal parts left over a ``SHRINK``-th of the rows, the next round cuts at approximate quantiles instead, which no distribution defeats.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize, scope

LEAF, BUCKETS, SHRINK = 1 << 18, 1024, 8
PIVOTS = 15

Condition = Callable[[Column, Column], Column]


def _sorted(rows: DataFrame, key: list[str], holds: Condition) -> DataFrame:
    """The answer of each key from its rows (z, tie, w) and ``base_``, the weight below them; a window of a key."""
    w = Window.partitionBy(*key)
    upto = F.col("base_") + F.sum("w").over(w.orderBy("z", "tie").rowsBetween(Window.unboundedPreceding, 0))
    running = rows.withColumn("upto", upto)
    first = running.filter(holds(F.col("z"), F.col("upto"))).groupBy(*key).agg(F.min_by(F.struct("z", (F.col("upto") - F.col("w")).alias("before"), "upto"), F.struct("z", "tie")).alias("x"))
    return first.select(*key, "x.z", "x.before", "x.upto")


def _parts(rows: DataFrame, key: list[str], targets: DataFrame, holds: Condition) -> DataFrame:
    """low_, high_, rows_, base_ and upto (weight before and through) of the part that holds each key's answer, and ``was_``, the rows before. rows: z, w and the key's range with pivots_."""
    half = lambda c: F.col(c).cast("double") / 2  # noqa: E731  so that no difference overflows
    share = F.coalesce(F.try_divide(half("z") - half("low_"), half("high_") - half("low_")), F.lit(0.0))
    equal = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    # a pivot's own value is a part, so many rows of one value cannot stall a round
    by_pivot = F.aggregate("pivots_", F.lit(0).cast("long"), lambda a, p: a + (F.col("z") > p).cast("long") + (F.col("z") >= p).cast("long"))
    counted = rows.withColumn("part_", F.when(F.col("pivots_").isNull(), equal).otherwise(by_pivot)).groupBy(*key, "part_").agg(
        F.count("*").alias("m"), F.sum("w").alias("inside_"), F.min("z").alias("low_"), F.max("z").alias("high_"), F.first("base_").alias("base_"), F.first("rows_").alias("was_"))
    upto = F.col("base_") + F.sum("inside_").over(Window.partitionBy(*key).orderBy("part_").rowsBetween(Window.unboundedPreceding, 0))
    running = counted.withColumn("upto", upto).join(targets, key).filter(holds(F.col("high_"), F.col("upto")))
    answer = F.struct("low_", "high_", F.col("m").alias("rows_"), (F.col("upto") - F.col("inside_")).alias("base_"), "upto", "was_")
    return running.groupBy(*key).agg(F.min_by(answer, "part_").alias("x")).select(*key, "x.*")


def crossings(values: DataFrame, targets: DataFrame, key: str, holds: Condition, leaf: int = LEAF, largest: int | None = None, weight: Column | None = None) -> DataFrame:
    """The columns of ``targets``, with z, before and upto: the first z of the key's ``values`` at which ``holds(z, upto)``, and the weight before it and up to it.

    values: key, z, tie (the order of equal z) and w, not negative; targets: unique rows of key, t and what ``holds`` reads, which must rise with z and weight. z is null where it never holds,
    and where the key has no values. ``largest`` is a bound of a key's rows, if known; ``weight`` takes the place of w and may read what
    targets hold of the key (the same in all of its rows). Of a large key's rows of equal z ``before`` and ``upto`` may be those of all together.
    """
    names = [key, "t"]
    values = values.select(key, "z", "tie", "w")
    zero = F.lit(0).cast(dict(values.agg(F.sum("w").alias("s")).dtypes)["s"])
    weighed = lambda rows: rows if weight is None else rows.withColumn("w", weight)
    if (largest is not None and largest <= leaf) or values.groupBy(key).agg(F.count("*").alias("rows_")).filter(F.col("rows_") > leaf).isEmpty():
        return targets.join(_sorted(weighed(values.join(targets, key)).withColumn("base_", zero), names, holds), names, "left")
    if weight is not None:
        values = weighed(values.join(targets.dropDuplicates([key]), key)).select(key, "z", "tie", "w")
    sizes = values.groupBy(key).agg(F.count("*").alias("rows_"), F.min("z").alias("low_"), F.max("z").alias("high_"), F.sum("w").alias("upto")).filter(F.col("rows_") > leaf)
    with scope(values.sparkSession) as keep:
        sizes = materialize(sizes, "sizes")
        found = [_sorted(values.join(sizes, key, "left_anti").join(targets, key).withColumn("base_", zero), names, holds)]
        ranges = targets.join(sizes, key).filter(holds(F.col("high_"), F.col("upto"))).select(*names, "low_", "high_", "rows_", zero.alias("base_"), "upto", F.lit(False).alias("slow_"))
        single = F.col("low_") == F.col("high_")
        inside = lambda r: values.join(r, key).filter((F.col("z") >= F.col("low_")) & (F.col("z") <= F.col("high_")))
        pivots = F.percentile_approx("z", [k / (PIVOTS + 1) for k in range(1, PIVOTS + 1)], 1000)
        while True:
            ranges = materialize(ranges, "ranges")
            few, wide = ranges.filter(~single & (F.col("rows_") <= leaf)), ranges.filter(~single & (F.col("rows_") > leaf))
            found.append(ranges.filter(single).select(*names, F.col("low_").alias("z"), F.col("base_").alias("before"), "upto"))
            found.append(_sorted(inside(few).select(*names, "z", "tie", "w", "base_").join(targets, names), names, holds))
            if wide.isEmpty():
                break
            cuts = inside(wide.filter("slow_")).groupBy(*names).agg(pivots.alias("pivots_"))
            parts = _parts(inside(wide).join(cuts, names, "left"), names, targets, holds)
            ranges = parts.select(*names, "low_", "high_", "rows_", "base_", "upto", (F.col("rows_") * SHRINK > F.col("was_")).alias("slow_"))
        return keep(materialize(targets.join(reduce(DataFrame.unionByName, found), names, "left"), "crossings"))
