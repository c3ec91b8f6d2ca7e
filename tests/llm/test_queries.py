"""The registered queries over the driver's smallest tables, against brute force."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
queries = pytest.importorskip("fusewright.llm.queries")


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_packing_query(spark, texts):
    from test_pack_warc_leaks import check_packed

    used, bound = check_packed(texts, queries.op1_config_lp_packing(spark, SF).collect())
    assert used <= bound + 1


def test_repeats_query(spark, texts):
    from test_dedup import brute_repeats

    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op7_repeats(spark, SF).collect()}
    assert got == dict(zip([k for k, _ in texts], brute_repeats([t for _, t in texts])))


def test_simhash_query(spark, texts):
    from test_dedup import brute_fingerprint, classes

    fps = {k: brute_fingerprint(t) for k, t in texts}
    links = [(a, b) for a in fps for b in fps if b < a and (fps[a] ^ fps[b]).bit_count() <= 2]
    expected = {k: (f"{fps[k]:016x}", c) for k, c in classes(fps, links).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SF).collect()} == expected


def test_line_query(spark, texts):
    out = {r["doc_id"]: r for r in queries.op4_line_dedup(spark, SF).collect()}
    assert len(out) == len(texts) and sum(r["n_removed"] for r in out.values()) > 0
    for key, text in texts:
        lines = [] if text is None else text.split("\n")
        assert out[key]["n_lines"] == len(lines) and out[key]["n_removed"] == len(out[key]["removed"])
        assert (out[key]["text"] or "") == "\n".join(x for n, x in enumerate(lines) if n not in set(out[key]["removed"]))
    # no two lines that stay are equal but blank ones
    stay = [x for r in out.values() for x in (r["text"] or "").split("\n") if x.strip()]
    assert len(stay) == len(set(stay))


def test_sql_of_the_queries(spark):
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SF)
        columns, expected = sorted(got.columns), con.sql(sql)
        order = [expected.columns.index(c) for c in columns]
        assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[k] for k in order]) for r in expected.fetchall()), name
