"""Consecutive numbers and running values in an order, without one task that holds all rows or all of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize


def with_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the row's number from 0 by the unique key ``order``.

    Rows are dealt by range and written once; a range's first number is the count of those before it (one row per range).
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy("range_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    inside = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return ranged.withColumn("in_", inside).join(F.broadcast(starts), "range_").withColumn(name, (F.col("start_") + F.col("in_")).cast("long")).drop("range_", "in_", "start_")


def with_chunk(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Adds ``chunk``: the row's number in its group by ``order`` (unique in a group), from 0, in chunks of ``size``. A large group is ranked by ranges, like all rows."""
    ranked = with_rank(df, [group, order], "position_")
    starts = ranked.groupBy(group).agg(F.min("position_").alias("start_"))
    chunk = F.floor((F.col("position_") - F.col("start_")) / size).cast("long")
    return ranked.join(starts, group).withColumn("chunk", chunk).drop("position_", "start_")


Scan = tuple[str, Column]
_TIE = "tie_"


def in_parts(df: DataFrame, group: str, order: str, parts: int | None = None) -> DataFrame:
    """``df`` dealt by range of (group, order) and written, with ``part_``: a large group has many parts, one after another in order. ``parts``: as many, else by size.

    Rows of one value are dealt to several parts too, so nothing that is scanned may depend on their order.
    """
    tied = df.withColumn(_TIE, F.rand(17))
    dealt = tied.repartitionByRange(group, order, _TIE) if parts is None else tied.repartitionByRange(parts, group, order, _TIE)
    return materialize(dealt.drop(_TIE).withColumn("part_", F.spark_partition_id()), "parts")


def running(parts: DataFrame, group: str, order: str, scans: dict[str, Scan], before: bool = False) -> DataFrame:
    """Adds each scan, the running ``sum``, ``min`` or ``max`` of a column down the group by ``order``; with ``before``, of the rows before alone.

    Two levels: inside each of ``in_parts``' parts, and over the parts' totals, a row for each part of a group. No task holds a group.
    """
    agg = {"sum": F.sum, "min": F.min, "max": F.max}
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    inside, outside = Window.partitionBy(group, "part_").orderBy(order), Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    totals = parts.groupBy(group, "part_").agg(*[agg[f](c).alias(f"{name}_in") for name, (f, c) in scans.items()])
    lower = totals.select(group, "part_", *[agg[f](F.col(f"{name}_in")).over(outside).alias(f"{name}_below") for name, (f, _) in scans.items()])
    joined = parts.join(lower, [group, "part_"])
    return joined.withColumns({name: join[f](F.col(f"{name}_below"), agg[f](c).over(inside)) for name, (f, c) in scans.items()}).drop(*[f"{name}_below" for name in scans])
