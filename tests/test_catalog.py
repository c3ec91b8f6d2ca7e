"""Every catalogue query against its SQL in DuckDB, and the streaming helpers."""

import math
from pathlib import Path

import duckdb
import pytest

from fusewright.plans import catalog, checks  # noqa: F401
from fusewright.streaming.incremental import stream_group_stats, stream_pairs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    return None if v is None else repr(None if isinstance(v, float) and math.isnan(v) else v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    expected = db.sql(catalog.ORACLE_SQL[name])
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    ours = sorted(tuple(norm(r[c]) or "" for c in columns) for r in got.collect())
    theirs = sorted(tuple(norm(r[k]) or "" for k in order) for r in expected.fetchall())
    assert ours == theirs


def test_plans_push_down(spark):
    plan = catalog.QUERIES["group_stats_supplier"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_the_flagship_scans_once(spark):
    plan = catalog.QUERIES["flagship_fused_suppliers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "stats-" in plan  # all is built on what one scan has left


@pytest.mark.parametrize("name", ["loc_median", "loc_huber", "loc_lts", "prox_chain"])
def test_no_group_becomes_an_array(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("collect_list", "percentile", "median(", "BatchEvalPython"))


def test_streams(spark, tmp_path):
    spark.createDataFrame([(0, 1.0), (1, 4.0), (0, 3.0)], "group_id long, y double").write.parquet(str(tmp_path / "obs"))
    stream = spark.readStream.schema("group_id long, y double").parquet(str(tmp_path / "obs"))
    q = stream_group_stats(stream).writeStream.outputMode("complete").format("memory").queryName("stats").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("stats").collect()) == [(0, 2, 4.0, 2.0), (1, 1, 4.0, 4.0)]
    pairs = spark.createDataFrame([(1, 0, 1.0), (0, 1, 2.0), (1, 1, 9.0)], "u long, v long, weight double")
    assert [tuple(r) for r in stream_pairs(pairs).collect()] == [(0, 1, 3.0)]
    with pytest.raises(ValueError):
        stream_pairs(pairs, "first")


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.ORACLE_SQL) <= set(entry.oracle_sql())
