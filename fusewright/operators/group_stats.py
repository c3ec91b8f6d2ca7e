"""Size, sum and mean per group over a spine of all group ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions.schemas import require, spine
from fusewright.functions.sums import exponent_above, joined_limbs, limb_sums
from fusewright.functions.validation import IN_PLAN, check, guard, positive_int, violations


def infer_n_groups(obs: DataFrame) -> int:
    """The largest id plus one, or 0."""
    top = obs.agg(F.max("group_id")).head()[0]
    return 0 if top is None else int(top) + 1


def group_stats(obs: DataFrame, n_groups: int | None = None, validate: bool | str = True, reproducible: bool = False) -> DataFrame:
    """group_id, size, sum and mean; groups without rows have zeros. A DECIMAL ``y`` is summed exactly. No rows: no groups.

    validate: ``IN_PLAN`` with ``n_groups`` makes a bad row an error of the job that reads the rows, and no job runs before. reproducible: doubles are
    summed so that the order of rows does not show (finite values only); a job finds the largest first.
    """
    obs = require(obs, "group_id", "y")
    if n_groups is not None:
        positive_int(n_groups, "n_groups")
    if validate == IN_PLAN:
        if n_groups is None:
            raise ValueError("n_groups must be given where rows are validated in the plan")
        obs = guard(obs, "group_id", non_negative=True, upper=n_groups, inclusive=False)
        if not reproducible:
            sums = obs.groupBy("group_id").agg(F.count("*").alias("size"), F.sum("y").cast("double").alias("sum"))
            return padded_stats(sums, n_groups)
    elif validate:
        check(obs, violations("group_id", non_negative=True, upper=n_groups, inclusive=False))
    n = infer_n_groups(obs) if n_groups is None or obs.isEmpty() else n_groups
    if reproducible and dict(obs.dtypes)["y"] == "double":
        exponent = exponent_above(obs.agg(F.max(F.abs("y"))).head()[0])
        limbs = obs.groupBy("group_id").agg(F.count("*").alias("size"), *limb_sums("y", exponent))
        return padded_stats(limbs.select("group_id", "size", joined_limbs(exponent).alias("sum")), n)
    sums = obs.groupBy("group_id").agg(F.count("*").alias("size"), F.sum("y").cast("double").alias("sum"))
    return padded_stats(sums, n)


def padded_stats(sums: DataFrame, n: int) -> DataFrame:
    """group_id, size, sum and mean of ids 0 to ``n`` - 1 from the size and sum of groups with rows."""
    padded = spine(sums.sparkSession, n).join(sums, "group_id", "left")
    size, total = F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("sum", F.lit(0.0)).alias("sum")
    return padded.select("group_id", size, total, F.when(F.col("size") > 0, F.col("sum") / F.col("size")).otherwise(0.0).alias("mean"))


def grouping_flag(obs: DataFrame, n_groups: int | None = None) -> DataFrame:
    """One row: ``is_grouped_data`` is false if each row is the group of its own position, or without rows."""
    obs = require(obs, "obs_idx", "group_id")
    own = F.coalesce(F.bool_and(F.col("group_id") == F.col("obs_idx")), F.lit(True))
    n = F.lit(n_groups) if n_groups is not None else F.coalesce(F.max("group_id") + 1, F.lit(0))
    return obs.agg((~(own & (F.count("*") == n)) & (F.count("*") > 0)).alias("is_grouped_data"))
