"""Group statistics of a stream, for the operators whose results grow by addition.

The reference semantics are those of a batch; sizes, sums and means, merged duplicate pairs (the first by pair_idx and running means too) and codes of known
labels are the ones that a running aggregate or a join with a table can keep. Their state is Spark's, so a query goes on from its checkpoint. Medians, robust estimates, scalar solutions and components need the batch operators, for
example in ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions.schemas import require
from fusewright.operators.pairs import canonicalize


def stream_group_stats(obs: DataFrame) -> DataFrame:
    """group_id, size, sum and mean of all rows so far; for the ``complete`` or ``update`` output mode. There is no spine: groups appear with their first row."""
    sums = require(obs, "group_id", "y").groupBy("group_id").agg(F.count("*").alias("size"), F.sum("y").cast("double").alias("sum"))
    return sums.withColumn("mean", F.col("sum") / F.col("size"))


def stream_pairs(pairs: DataFrame, how: str = "sum") -> DataFrame:
    """u, v and weight of a stream of pairs, duplicates merged by sum, max or min."""
    merge = {"sum": F.sum, "max": F.max, "min": F.min}.get(how)
    if merge is None:
        raise ValueError(f"a stream cannot merge duplicates by {how!r}")
    ordered = require(pairs, "u", "v", "weight").filter("u <> v").withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})
    return ordered.groupBy("u", "v").agg(merge("weight").alias("weight"))


def stream_canonical_pairs(pairs: DataFrame, how: str = "first") -> DataFrame:
    """u, v and weight of all pairs of a stream so far, by any duplicate strategy, as ``canonicalize`` gives them for a batch; for the ``complete`` or ``update`` output mode.

    ``first`` keeps the weight of the least pair_idx seen, which a late row of a lesser one replaces; ``mean`` keeps a sum and a count.
    """
    return canonicalize(pairs, how)


def stream_encode(stream: DataFrame, dictionary: DataFrame, column: str = "label", strict: bool = True) -> DataFrame:
    """Adds ``code`` from an encoder's ``dictionary``, a stream-static join. With ``strict`` an unknown or null label is an error of the batch, else its code is null."""
    known = dictionary.select(F.col("label").alias("known_"), "code")
    joined = stream.join(known, F.col(column) == F.col("known_"), "left").drop("known_")
    if not strict:
        return joined
    sound = F.assert_true(F.col("code").isNotNull(), F.lit("unknown label")).isNull()
    return joined.withColumn("code", F.when(sound, F.col("code")))
