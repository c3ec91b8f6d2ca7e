"""Lineage cuts in the folder that all executors share.

Tables go below ``spark.checkpoint.dir``. They survive the loss of any executor,
keep Parquet's column pruning and give the optimiser true sizes. Only where a local
session names no such folder (unit tests on one machine) one is made here; on a cluster that is an error.

Tables last until the application ends, or to the end of the ``scope`` in which they are written, but for those that it keeps.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a slash at its end."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fusewright-"))
            current = sc._jsc.sc().getCheckpointDir()
        named = current.get()
    return named.rstrip("/")


def _path(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, label: str) -> str:
    """A new URI in the shared folder, deleted when the application ends."""
    uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    path, fs = _path(spark, uri)
    fs.deleteOnExit(path)
    if (made := _SCOPE.get()) is not None:
        made.append(uri)
    return uri


def _delete(spark: SparkSession, uri: str) -> None:
    path, fs = _path(spark, uri)
    fs.delete(path, True)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that ``materialize`` gave."""
    _delete(spark, df._stored_at)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables written in it, but for those given to what it yields, which are the outer scope's."""
    outer, made = _SCOPE.get(), []
    token = _SCOPE.set(made)

    def keep(df: DataFrame) -> DataFrame:
        made.remove(df._stored_at)
        if outer is not None:
            outer.append(df._stored_at)
        return df

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for uri in made:
            _delete(spark, uri)


def materialize(df: DataFrame, label: str = "table", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back: the lineage ends here."""
    spark = df.sparkSession
    uri = scratch(spark, label)
    df.write.options(**options).parquet(uri)
    stored = spark.read.schema(df.schema).parquet(uri)
    stored._stored_at = uri
    return stored


def exists(spark: SparkSession, uri: str) -> bool:
    path, fs = _path(spark, uri)
    return fs.exists(path)
