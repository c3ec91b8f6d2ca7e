"""What the operators share: batch functions and reading tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.functions import shipping

SLICE_BYTES = 4 << 20
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and bound the batches that Spark sends to Python unless the session has a lower bound; they are held on both sides."""
    shipping.ship(spark)
    conf = spark._jsparkSession.sessionState().conf()
    if conf.arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``df.mapInArrow`` for a function of one batch of about ``SLICE_BYTES``; empty batches and ``None`` are passed over."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, int(SLICE_BYTES * batch.num_rows / max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, rows):
                if (out := work(batch.slice(first, rows))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


class ByteCache(dict):
    """A dict of at most ``most`` bytes: of keys, of values as ``keep`` says, and ``EACH`` for an entry."""

    EACH = 200

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def keep(self, key: str | bytes, value: object, size: int, renew: bool = False) -> None:
        """Store ``value`` of ``size`` bytes while there is room; with ``renew``, all others go to make room. What is too large for the cache is not stored."""
        size += len(key) + self.EACH
        if self.held + size > self.most and renew and size <= self.most:
            self.clear()
            self.held = 0
        if self.held + size <= self.most:
            self[key] = value
            self.held += size


def utf8(column: pa.Array) -> list[bytes]:
    """The strings as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
