"""Pairs, the graph, components and encoders on worked values."""

import random

import numpy as np
import pytest

from fusewright.functions.schemas import obs_from_arrays, pairs_from_array
from fusewright.operators import components as comp
from fusewright.operators.encoding import LabelEncoder
from fusewright.operators.pairs import canonicalize, check_fusion_pairs, check_groups_and_pairs
from fusewright.operators.structure import FusionGraph, build_graph


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def canon(spark, pairs, weights, how="first", n=None):
    df, n = check_fusion_pairs(pairs_from_array(spark, pairs, weights), n, how)
    return rows(df, "u", "v"), n


def test_canonical_pairs(spark):
    assert canon(spark, [(1, 0), (0, 1), (1, 1), (2, 0)], [1, 2, 0.5, 1.5]) == ([(0, 1, 1.0), (0, 2, 1.5)], 3)
    for how, w in (("first", 1.0), ("sum", 6.0), ("mean", 2.0), ("max", 3.0), ("min", 1.0)):
        assert canon(spark, [(0, 1), (1, 0), (0, 1)], [1, 2, 3], how) == ([(0, 1, w)], 2)
    assert canon(spark, [(0, 0), (1, 1)], [1, 1]) == ([], 0)
    assert canon(spark, [(0, 1), (0, 256), (256, 0)], [1, 2, 3]) == ([(0, 1, 1.0), (0, 256, 2.0)], 257)
    again = canonicalize(canonicalize(pairs_from_array(spark, [(2, 1), (1, 2)], [1, 2]), "sum"), "sum")
    assert rows(again, "u") == [(1, 2, 3.0)]


@pytest.mark.parametrize("pairs, weights, n, how", [([(0, 1)], [0], None, "first"), ([(0, 1)], [float("nan")], None, "first"), ([(-1, 1)], [1], None, "first"), ([(0, 3)], [1], 3, "first"), ([(0, 1)], [1], 0, "first"), ([(0, 1)], [1], None, "median")])
def test_pairs_rejected(spark, pairs, weights, n, how):
    with pytest.raises(ValueError):
        canon(spark, pairs, weights, how, n)


def test_pair_layouts(spark):
    assert rows(pairs_from_array(spark, [[0, 1, 2], [3, 4, 5]]).select("u", "v"), "u") == [(0, 3), (1, 4), (2, 5)]
    for bad in ([[0, 1, 2]], [[0, 1, 2], [3, 4]]):
        with pytest.raises(ValueError):
            pairs_from_array(spark, bad)
    with pytest.raises(ValueError):
        pairs_from_array(spark, [(0, 1)], [1.0, 2.0])


def test_grid(spark):
    obs = obs_from_arrays(spark, [0.0] * 9, range(9))
    grid = [(3 * r + c, 3 * r + c + 1) for r in range(3) for c in range(2)] + [(3 * r + c, 3 * r + c + 3) for r in range(2) for c in range(3)]
    n, pairs = check_groups_and_pairs(obs, pairs_from_array(spark, grid))
    assert (n, pairs.count()) == (9, 12)
    with pytest.raises(ValueError):
        check_groups_and_pairs(obs, pairs_from_array(spark, [(0, 9)]))


def test_graph(spark):
    g = FusionGraph(pairs_from_array(spark, [(0, 1), (1, 2), (2, 0)], [1, 2, 1.5]), 5)
    assert rows(g.pairs, "u", "v") == [(0, 1, 1.0), (0, 2, 1.5), (1, 2, 2.0)]
    assert (g.neighbors(1), g.neighbor_weights(1), g.neighbors(4), g.degree(0)) == ([0, 2], [1.0, 2.0], [], 2)
    assert [r[1] for r in rows(g.degrees(), "node")] == [2, 2, 2, 0, 0]
    assert repr(g) == "FusionGraph(n_params=5, n_pairs=3, mean_degree=1.20)" and len(g) == 5
    for i in (-1, 5):
        with pytest.raises(IndexError):
            g.neighbors(i)
    lists = {r["node"]: [tuple(x) for x in r["nbrs"]] for r in g.adjacency_list().collect()}
    assert lists == {0: [(1, 1.0), (2, 1.5)], 1: [(0, 1.0), (2, 2.0)], 2: [(0, 1.5), (1, 2.0)], 3: [], 4: []}


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_compressed_rows_and_chunks(spark, block):
    """A hub, isolated nodes at both ends and between, and no pairs at all."""
    rng = random.Random(block)
    pairs = [(5, k) for k in range(60) if k != 5 and k % 3] + [(rng.randrange(10, 50), rng.randrange(10, 50)) for _ in range(60)]
    g = FusionGraph(pairs_from_array(spark, pairs, [float(k + 1) for k in range(len(pairs))]), 64)
    nbrs = {}
    for node, nbr, weight in rows(g.adjacency, "node", "nbr"):
        nbrs.setdefault(node, []).append((nbr, weight))
    csr = g.compressed_rows(block)
    at = 0
    for node, start, stop in rows(csr.pointers, "node"):
        assert (start, stop) == (at, at + len(nbrs.get(node, [])))
        at = stop
    assert max(len(r["nbrs"]) for r in csr.blocks.collect()) <= block
    assert rows(csr.rows(), "node", "nbr") == rows(g.adjacency, "node", "nbr")
    for node in (0, 5, 11, 63):
        assert [tuple(r) for r in csr.neighbor_data(node).collect()] == nbrs.get(node, [])
    with pytest.raises(IndexError):
        csr.neighbor_data(64)
    chunks = {}
    for node, chunk, some in rows(g.adjacency_chunks(block), "node", "chunk"):
        assert chunk * block == len(chunks.setdefault(node, [])) and 0 < len(some) <= block
        chunks[node] += [tuple(e) for e in some]
    assert chunks == nbrs
    empty = FusionGraph(pairs_from_array(spark, [(1, 1)]), 3).compressed_rows(block)
    assert rows(empty.pointers, "node") == [(0, 0, 0), (1, 0, 0), (2, 0, 0)] and empty.rows().collect() == [] and empty.neighbor_data(1).collect() == []


def test_members_in_chunks(spark):
    labels = graph_labels(spark, 50, [(k, k + 2) for k in range(0, 40)] + [(44, 45)])
    whole = {r["component"]: r["members"] for r in comp.component_members(labels).collect()}
    for size in (1, 4, 100):
        got = {}
        for component, chunk, members in rows(comp.component_member_chunks(labels, size), "component", "chunk"):
            assert len(got.setdefault(component, [])) == chunk * size and len(members) <= size
            got[component] += members
        assert got == whole


def test_incidence(spark):
    g = FusionGraph(pairs_from_array(spark, [(0, 1), (1, 2)], [1, 2]))
    assert rows(g.incidence(), "pair_idx", "node") == [(0, 0, 1.0), (1, 0, -1.0), (1, 1, 2.0), (2, 1, -2.0)]
    assert [r[2] for r in rows(g.incidence(weighted=False), "pair_idx", "node")] == [1.0, -1.0, 1.0, -1.0]
    assert {r["node"]: r["nbrs"] for r in g.adjacency_map().collect()} == {0: {1: 1.0}, 1: {0: 1.0, 2: 2.0}, 2: {1: 2.0}}
    theta = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 10.0)], "group_id long, theta double")
    assert rows(g.pair_differences(theta), "pair_idx") == [(0, -4.0), (1, -10.0)]


def test_builder(spark):
    obs = obs_from_arrays(spark, [1, 2, 3, 10, 11, 12], [0, 0, 0, 1, 1, 1])
    pairs = pairs_from_array(spark, [(0, 1), (1, 1)], [7, 7])
    weight = lambda **o: build_graph(obs, pairs, **o).pairs.head()["weight"]
    assert weight() == pytest.approx(1 / 9)
    assert (weight(adaptive=False), weight(weighted=True)) == (1.0, 7.0)
    assert weight(method="median", gamma=2.0) == pytest.approx(1 / 81)


def graph_labels(spark, n, edges):
    nodes = spark.range(n).withColumnRenamed("id", "node")
    return comp.connected_components(nodes, spark.createDataFrame(edges, "u long, v long"))


def test_components(spark):
    labels = graph_labels(spark, 8, [(0, 1), (1, 2), (2, 3), (5, 6), (4, 4)])
    assert rows(labels, "node") == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 5), (6, 5), (7, 7)]
    assert tuple(comp.largest_component(labels).head()) == (0, 4)
    assert rows(comp.multi_element_components(labels), "component") == [(0, 4), (5, 2)]
    assert comp.component_members(labels).filter("component = 5").head()["members"] == [5, 6]
    asked = comp.connected(labels, spark.createDataFrame([(0, 3), (0, 4), (0, 99)], "x long, y long"))
    assert [r["connected"] for r in asked.orderBy("y").collect()] == [True, False, False]
    with pytest.raises(ValueError):
        comp.largest_component(labels.limit(0))


def test_random_and_long_components(spark):
    rng = random.Random(3)
    path = list(range(300))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(400 + rng.randrange(100), 400 + rng.randrange(100)) for _ in range(60)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert rows(graph_labels(spark, 500, edges), "node") == [(k, find(k)) for k in range(500)]
    table = spark.createDataFrame(edges, "u long, v long")
    expected = [(k, find(k)) for k in range(500) if find(k) != k]
    for block in (7, 100, 1 << 18):  # many blocks before the rounds, few, and one
        assert rows(comp.component_stars(table, block), "u") == expected
    assert comp.component_stars(table.select(*[table[c].cast("string").alias(c) for c in "uv"])).count() == len(expected)  # other names than numbers


def test_blocks_of_edges_become_stars():
    rng = np.random.default_rng(4)
    u, v = rng.integers(0, 60, (2, 45))
    x, y = comp.block_stars(u, v)
    left = dict(zip(x.tolist(), y.tolist()))
    at = lambda n: left.get(n, n)
    assert all(at(a) == at(b) for a, b in zip(u.tolist(), v.tolist())) and all(b < a and b not in left for a, b in left.items())
    sets = {frozenset((a, b)) for a, b in zip(u.tolist(), v.tolist())}
    reach = {n: {n} for n in range(60)}
    for _ in range(60):
        for a, b in map(lambda s: (min(s), max(s)), sets):
            both = reach[a] | reach[b]
            for n in both:
                reach[n] = both
    assert all(at(n) == min(reach[n]) for n in range(60))


def _sequential(n, pairs):
    """Whether each pair merges two sets, by joining them in order."""
    parent, out = list(range(n)), {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, u, v in sorted((p for p in pairs if p[1] is not None and p[2] is not None), key=lambda p: p[0]):
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
        out[k] = a != b
    return {k: out.get(k, False) for k, _, _ in pairs}


@pytest.mark.parametrize("shape", ["sparse", "dense", "path", "star"])
def test_merges(spark, shape):
    rng = random.Random(shape)
    n = 150
    ends = {
        "sparse": [(rng.randrange(n), rng.randrange(n)) for _ in range(120)], "dense": [(rng.randrange(30), rng.randrange(30)) for _ in range(500)],
        "path": [(k, k + 1) for k in rng.sample(range(n - 1), n - 1)], "star": [(0, k) for k in rng.sample(range(1, n), n - 1)] * 2,
    }[shape]
    pairs = [(k * 3 - 50, u, v) for k, (u, v) in zip(rng.sample(range(len(ends)), len(ends)), ends)] + [(9000, None, 3), (9001, 4, None), (9002, 5, 5)]
    table = spark.createDataFrame([(*p, "x") for p in pairs], "pair_idx long, u long, v long, merged_before string").repartition(5)
    expected = _sequential(n, pairs)
    for block in (4, 37, 1 << 18):
        got = comp.merges(table, block)
        assert got.columns == ["pair_idx", "u", "v", "merged_before", "merged"]
        assert {r["pair_idx"]: r["merged"] for r in got.collect()} == expected
    assert comp.merges(table.limit(0)).collect() == []


def test_ordered_unions_go_on_from_what_is_merged(spark):
    rng = random.Random(8)
    batches = [[(100 * b + k, rng.randrange(40), rng.randrange(40)) for k in range(25)] for b in range(3)]
    sets = comp.DisjointSets(spark, 40)
    expected = _sequential(40, [p for b in batches for p in b])
    for batch in batches:
        got = sets.union_ordered(spark.createDataFrame(batch, "pair_idx long, u long, v long"))
        assert {r["pair_idx"]: r["merged"] for r in got.collect()} == {k: expected[k] for k, _, _ in batch}
    assert sets.n_components == 40 - sum(expected.values())
    with pytest.raises(IndexError, match="2 rows"):
        sets.union_ordered(spark.createDataFrame([(0, 1, 40), (1, -1, 2), (2, 3, 4)], "pair_idx long, u long, v long"))


def test_disjoint_sets(spark):
    sets = comp.DisjointSets(spark, 4)
    assert sets.union_pair(0, 1) and not sets.union_pair(1, 0)
    assert (sets.find(1), sets.n_components, len(sets), sets.connected(0, 3)) == (0, 3, 4, False)
    sets.reset()
    assert sets.n_components == 4
    with pytest.raises(IndexError):
        sets.find(4)


def labels_of(spark, values, kind="long"):
    return spark.createDataFrame(list(enumerate(values)), f"obs_idx long, label {kind}")


def test_encoder(spark):
    df = labels_of(spark, [10, 5, 10, 15, 5])
    encoder = LabelEncoder()
    coded = encoder.fit_transform(df)
    assert [r["code"] for r in coded.orderBy("obs_idx").collect()] == [1, 0, 1, 2, 0]
    assert (encoder.classes, encoder.n_groups) == ([5, 10, 15], 3)
    assert [r["decoded"] for r in encoder.inverse_transform(coded.select("obs_idx", "code")).orderBy("obs_idx").collect()] == [10, 5, 10, 15, 5]
    assert LabelEncoder(sort=False).fit(labels_of(spark, [15, 5, 10]), index="obs_idx").classes == [15, 5, 10]
    pairs = encoder.transform_pairs(spark.createDataFrame([(5, 10), (10, 15)], "u_label long, v_label long"))
    assert rows(pairs.select("u", "v"), "u") == [(0, 1), (1, 2)]
    assert rows(encoder.inverse_transform_pairs(pairs.select("u", "v")).select("u_decoded", "v_decoded"), "u_decoded") == [(5, 10), (10, 15)]
    assert repr(encoder) == "LabelEncoder(sort=True, n_groups=3, classes=[5, 10, 15])"
    assert repr(LabelEncoder().fit(labels_of(spark, "abcdefg", "string"))).endswith("classes=[a, b, ..., g])")
    assert rows(encoder.unknown_labels(labels_of(spark, [5, 99])), "label") == [(99,)]


def test_encoder_errors(spark):
    encoder = LabelEncoder()
    assert not encoder.is_fitted
    with pytest.raises(ValueError, match="not fitted"):
        _ = encoder.dictionary
    encoder.fit(labels_of(spark, ["a", "b"], "string"))
    with pytest.raises(ValueError, match="unknown"):
        encoder.transform(labels_of(spark, ["c"], "string"))
    with pytest.raises(ValueError, match="unknown codes"):
        encoder.inverse_transform(spark.createDataFrame([(7,)], "code long"))
    with pytest.raises(ValueError, match="unknown codes"):
        encoder.inverse_transform_pairs(spark.createDataFrame([(0, 7)], "u long, v long"))
    for values, kind in (([1.0, float("nan")], "double"), (["a", None], "string")):
        with pytest.raises(ValueError, match="null or NaN"):
            LabelEncoder().fit(labels_of(spark, values, kind))
