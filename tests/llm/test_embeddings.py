"""The embedding join against all pairs."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from fusewright.llm import embedding_join as ej
from fusewright.llm.embedding_join import similar_embeddings

SF = "/root/testdata/sf0.001"


def brute(rows, similarity=0.98):
    """(vec_id, n_links, component_id, kept) of each row, by all pairs of a label."""
    good = [label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = [0] * len(rows)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    groups = {}
    for k, (_, v, label) in enumerate(rows):
        if good[k]:
            groups.setdefault((label, len(v)), []).append(k)
    for at in groups.values():
        x = np.array([rows[k][1] for k in at], np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= similarity, 1))):
            links[at[i]] += 1
            links[at[j]] += 1
            parent[find(at[i])] = find(at[j])
    least = {}
    for k, (key, *_) in enumerate(rows):
        r = find(k)
        if key is not None and (least.get(r) is None or key < least[r]):
            least[r] = key
    out = [(key, n, least.get(find(k), key)) for k, ((key, *_), n) in enumerate(zip(rows, links))]
    return sorted((repr(k), n, repr(c), k == c) for k, n, c in out)


def rows_of(df):
    return sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"]), r["kept"]) for r in df.collect())


def cloud(n, d, seed=0):
    """Vectors on their own, in small groups near the threshold, in one large group, and copies."""
    rng = np.random.RandomState(seed)
    base = rng.standard_normal((n, d))
    near = base[rng.randint(0, n // 4, n)] + rng.standard_normal((n, d)) * 0.14
    crowd = rng.standard_normal(d) + rng.standard_normal((n // 2, d)) * 0.1
    return np.concatenate((base, near, crowd, base[:20], base[:20] * 3, crowd[:9])).astype(np.float32).tolist()


@pytest.mark.parametrize("d", [1, 3, 10, 64])
def test_every_link_has_one_owner_and_meets_once(d):
    x = np.array(cloud(600, d), np.float32)
    x = x[(x != 0).any(axis=1)]
    points, budget = ej.rotated(ej.unit(x)), ej.budgets(d, 0.98)
    u = ej.unit(x)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.98, 1))
    apart = [((points[i, s:e] - points[j, s:e]) ** 2).sum(axis=1) <= budget[b] for b, (s, e) in enumerate(ej.bounds(d))]
    assert len(i) > 100 and np.logical_or.reduce(apart).all()
    for b, (s, e) in enumerate(ej.bounds(d)):
        # the tree decides no result: it may be grown on other rows
        tree = ej.grow(points[::3, s:e], 20_000, float(np.sqrt(budget[b])), [])
        row, leaf, home = ej.places(tree, points[:, s:e], budget[b])
        cells = {(r, x): h for r, x, h in zip(row.tolist(), leaf.tolist(), home.tolist())}
        own = dict(zip(row[home].tolist(), leaf[home].tolist()))
        assert len(own) == len(x)
        for p, q in zip(i[apart[b]].tolist(), j[apart[b]].tolist()):
            assert sum((p, c) in cells and (q, c) in cells for c in {own[p], own[q]}) == 1


def test_similar_embeddings(spark):
    rng = np.random.RandomState(4)
    rows = [(k, v, k % 3 if k % 11 else 0) for k, v in enumerate(cloud(200, 24))]
    odd = [None, [], [0.0] * 24, [None] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0], [1.0], [2.0, 0.0], [1e30] * 24, [1e-30] * 24, [-1e30] * 24]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(2000 + k, v, None) for k, v in enumerate([*odd, *[r[1] for r in rows[:9]]])]
    rows += [(None, rows[3][1], rows[3][2]), (None, [5.0, 5.0], 7), (3, rows[3][1], rows[3][2]), (5, [5.0, -5.0], 7)]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, id long, block string, first string")
    as_float = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows]
    assert rows_of(similar_embeddings(df)) == brute(as_float)
    assert similar_embeddings(df.limit(0)).collect() == []
    # and by the query's SQL
    queries = pytest.importorskip("fusewright.llm.queries")
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding", "label").toArrow())
    assert sorted((repr(k), n, repr(c), kept) for k, n, c, kept in con.sql(queries.ORACLE_SQL["op11_embedding_pigeonhole"]).fetchall()) == brute(as_float)
    doubles = df.selectExpr("vec_id", "CAST(embedding AS array<double>) embedding", "CAST(label AS string) label")
    assert rows_of(similar_embeddings(doubles, 0.9)) == brute(as_float, 0.9)


def test_large_cells(spark):
    """Over CHUNK rows in a cell: chunks meet in pairs; three labels, one holding most rows."""
    rng = np.random.RandomState(6)
    crowd = rng.standard_normal(16) + rng.standard_normal((5200, 16)) * 0.12
    rest = rng.standard_normal((900, 16))
    rows = [(k, v, 0 if k < 5900 else k % 2) for k, v in enumerate(np.concatenate((crowd, rest)).astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert rows_of(similar_embeddings(df)) == brute(rows)


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_embedding_query(spark):
    queries = pytest.importorskip("fusewright.llm.queries")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.op11_embedding_pigeonhole(spark, SF)
    assert dict(got.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert rows_of(got) == brute(rows)
