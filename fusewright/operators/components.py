"""Connected components by alternating large and small stars, and queries on them.

First the edges are contracted to stars in blocks of ``BLOCK_EDGES``, a task each, which keeps memory bounded and leaves at
most an edge for each node of a block, and again while that halves them; one block is a result. Then every round rewires each node to the least neighbour it knows, first upwards, then
downwards; the edge set shrinks to stars around the least node of each component in a
number of rounds that grows with the logarithm of the size, and the rounds end once it consists of such stars. Each round's edges are
written to the shared folder, so lineage stays short, executors may be lost, and a hub's
side of a join can be split at run time because both sides are plain tables. Graphs of one block end after the first step; tests and queries take small blocks through all of them.

``spanning_forest`` tells which pairs of an ordered table merge two sets when they are joined one after another: the least spanning forest by
position, by Borůvka's rounds. A pair that closes a cycle of earlier pairs within its block closes it in the whole table, so blocks drop such pairs
first, each in a task; then in every round each set takes the least pair that leaves it, and the sets that meet are one set of the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions.ordering import with_chunk
from fusewright.functions.shipping import ship
from fusewright.functions.storage import materialize, scope

BLOCK_EDGES = 1 << 18


def block_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' components as stars: every node but the least of its component, with that least node."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[inner], nodes[root[inner]]


def contract(edges: DataFrame, n_edges: int, block_edges: int) -> tuple[DataFrame, int]:
    """Stars of blocks of ``block_edges``, a task each, and the number of blocks."""
    blocks = max(1, -(-n_edges // block_edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def stars() -> pa.RecordBatch:
            u, v = block_stars(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
            for k in range(0, len(u), block_edges):
                held.append((u[k : k + block_edges], v[k : k + block_edges]))
                size += len(held[-1][0])
                if size >= 2 * block_edges:  # tasks are not dealt evenly
                    yield stars()
                    size = 0
        if held:
            yield stars()

    ship(edges.sparkSession)
    return materialize(edges.coalesce(blocks).mapInArrow(run, "u long, v long").distinct() if blocks > 1 else edges.coalesce(1).mapInArrow(run, "u long, v long"), "edges"), blocks


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return joined.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent, which has none: then the least node of a component is its only parent."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return nodes.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def component_stars(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(u, v): every node of an edge but the least of its component, with that least node. Loops and nulls are passed over."""
    with scope(edges.sparkSession) as keep:
        return keep(_stars(edges, block_edges))


def _stars(edges: DataFrame, block_edges: int) -> DataFrame:
    stars = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars = materialize(stars, "edges")
    if dict(stars.dtypes) == {"u": "bigint", "v": "bigint"}:
        before, n, blocks = 0, stars.count(), 2
        while blocks > 1 and (not before or 2 * n <= before):  # fewer blocks meet more edges of a component
            before = n
            stars, blocks = contract(stars, n, block_edges)
            n = stars.count()
        if blocks == 1:
            return stars
    while not _are_stars(stars):
        stars = materialize(_small_star(materialize(_large_star(stars), "edges")), "edges")
    return stars


def block_forest(order: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of the pairs that merge two sets when joined in ``order``; loops never do."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    rank = np.empty(len(u), np.int64)
    rank[np.argsort(order, kind="stable")] = np.arange(len(u))
    place, root, taken = np.arange(len(u)), np.arange(len(nodes)), np.zeros(len(u), bool)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        a, b, rank, place, x, y = (c[apart] for c in (a, b, rank, place, x, y))
        if not len(a):
            return np.flatnonzero(taken)
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, x, rank)
        np.minimum.at(least, y, rank)
        first = (least[x] == rank) | (least[y] == rank)
        taken[place[first]] = True
        # the chosen pairs make no cycle; hook greater to lesser roots until all agree
        x, y = x[first], y[first]
        while len(x):
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            x, y = root[x], root[y]
            x, y = x[x != y], y[x != y]


def _cut_cycles(pairs: DataFrame, blocks: int, block_edges: int) -> DataFrame:
    """The pairs (pair_idx, u, v, x, y) that close no cycle of earlier pairs in their block; x and y are the sets of u and v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def forest() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            keep = block_forest(*(rows.column(c).to_numpy() for c in ("pair_idx", "x", "y")))
            return rows.take(pa.array(keep)).combine_chunks().to_batches(max_chunksize=None)[0] if len(keep) else None

        for batch in batches:
            for k in range(0, batch.num_rows, block_edges):
                held.append(batch.slice(k, block_edges))
                size += held[-1].num_rows
                if size >= 2 * block_edges:  # tasks are not dealt evenly
                    if (out := forest()) is not None:
                        yield out
                    size = 0
        if held and (out := forest()) is not None:
            yield out

    ship(pairs.sparkSession)
    return materialize(pairs.coalesce(blocks).mapInArrow(run, "pair_idx long, u long, v long, x long, y long"), "forest")


def spanning_forest(pairs: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """pair_idx, u and v of the ``pairs`` that merge two sets when all are joined in order of their unique pair_idx. Loops and nulls merge nothing."""
    with scope(pairs.sparkSession) as keep:
        return keep(materialize(_forest(pairs, block_edges), "forest"))


def _forest(pairs: DataFrame, block_edges: int) -> DataFrame:
    names = ("pair_idx", "u", "v")
    long_ = [F.col(c).cast("long").alias(c) for c in names]
    left = pairs.filter("u <> v").select(*long_).withColumns({"x": F.col("u"), "y": F.col("v")})
    left = materialize(left, "pairs")
    found = left.select(*names).limit(0)
    while not left.isEmpty():
        before, n, blocks = 0, left.count(), 2
        while blocks > 1 and (not before or 2 * n <= before):  # fewer blocks close more cycles
            before, blocks = n, max(1, -(-n // block_edges))
            left = _cut_cycles(left, blocks, block_edges)
            n = left.count()
        if blocks == 1:
            return found.unionByName(left.select(*names))
        ends = left.select(F.explode(F.array("x", "y")).alias("set"), "pair_idx")
        least = ends.groupBy("set").agg(F.min("pair_idx").alias("pair_idx")).select("pair_idx").distinct()
        chosen = materialize(left.join(least, "pair_idx"), "chosen")
        found = found.unionByName(chosen.select(*names))
        stars = component_stars(chosen.select(F.col("x").alias("u"), F.col("y").alias("v")), block_edges)
        to = lambda c: stars.select(F.col("u").alias(c), F.col("v").alias(f"{c}_to"))  # noqa: B023, E731
        moved = left.join(to("x"), "x", "left").join(to("y"), "y", "left")
        moved = moved.select(*names, F.coalesce("x_to", "x").alias("x"), F.coalesce("y_to", "y").alias("y")).filter("x <> y")
        # of pairs between the same two sets the first alone can merge them
        first = moved.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min_by(F.struct(*names), "pair_idx").alias("p"))
        left = materialize(first.select("p.*", "x", "y"), "pairs")
    return found


def merges(pairs: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """The rows of ``pairs`` with ``merged``: whether u and v were apart when their turn came, in order of the unique pair_idx."""
    forest = spanning_forest(pairs, block_edges).select("pair_idx", F.lit(True).alias("merged"))
    return pairs.join(forest, "pair_idx", "left").withColumn("merged", F.coalesce("merged", F.lit(False)))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for every row of ``nodes``; a component is named by its least node."""
    stars = component_stars(edges).select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.select("node").join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_members(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))


def component_member_chunks(labels: DataFrame, size: int = 1 << 12) -> DataFrame:
    """component, chunk (from 0) and members, at most ``size`` in order: the members in rows of bounded size, one after another."""
    return with_chunk(labels, "component", "node", size).groupBy("component", "chunk").agg(F.array_sort(F.collect_list("node")).alias("members"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def largest_component(labels: DataFrame) -> DataFrame:
    """Its row of ``component_sizes``; ties go to the least member. No nodes: an error, as there is none."""
    if labels.isEmpty():
        raise ValueError("there are no nodes")
    return component_sizes(labels).orderBy(F.desc("size"), "component").limit(1)


def multi_element_components(labels: DataFrame) -> DataFrame:
    return component_sizes(labels).filter("size > 1")


def connected(labels: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds ``connected`` to rows with x and y."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    both = queries.join(of("x"), "x", "left").join(of("y"), "y", "left")
    return both.withColumn("connected", F.coalesce(F.col("x_component") == F.col("y_component"), F.lit(False))).drop("x_component", "y_component")


class DisjointSets:
    """A partition of 0..n-1 that grows by batches of edges, or pair by pair; representatives are least members.

    The labels are a stored table. Pairs merged one by one since it was stored are kept as merged representatives on the driver, one entry a call, and join the
    edges when labels are asked for, so a pair costs two look-ups and no new table.
    """

    def __init__(self, spark, n: int):
        if n < 0:
            raise ValueError("n must be non-negative")
        self._spark, self.n = spark, n
        self.reset()

    def reset(self) -> None:
        self._edges: DataFrame | None = None  # not yet in the labels
        self._merged: dict[int, int] = {}
        nodes = self._spark.range(self.n)
        self._labels = nodes.select(F.col("id").alias("node"), F.col("id").alias("component"))

    def union(self, edges: DataFrame) -> DisjointSets:
        """Merge along ``edges`` (u, v)."""
        new = edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
        self._edges = new if self._edges is None else self._edges.unionByName(new)
        return self

    def union_ordered(self, pairs: DataFrame) -> DataFrame:
        """Merge along ``pairs`` (pair_idx, u, v) one after another, and tell of each whether it merged two sets: pair_idx, u, v and merged."""
        bad = pairs.agg(F.count_if((F.least("u", "v") < 0) | (F.greatest("u", "v") >= self.n))).head()[0]
        if bad:
            raise IndexError(f"pairs must be in [0, {self.n}) ({bad} rows are not)")
        labels = self._settle()
        at = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        inside = pairs.select("pair_idx", "u", "v").join(at("u"), "u").join(at("v"), "v").select("pair_idx", F.col("u_in").alias("u"), F.col("v_in").alias("v"))
        forest = spanning_forest(inside)
        self.union(forest.select("u", "v"))
        merged = forest.select("pair_idx", F.lit(True).alias("merged"))
        return pairs.select("pair_idx", "u", "v").join(merged, "pair_idx", "left").withColumn("merged", F.coalesce("merged", F.lit(False)))

    def union_pair(self, x: int, y: int) -> bool:
        """Merge two elements; True if they were apart."""
        a, b = self.find(x), self.find(y)
        if a != b:
            self._merged[max(a, b)] = min(a, b)
        return a != b

    def _check(self, *xs: int) -> None:
        for x in xs:
            if not 0 <= x < self.n:
                raise IndexError(f"element {x} is out of range [0, {self.n})")

    def _settle(self) -> DataFrame:
        """The stored labels, with all batches in them."""
        if self._edges is not None:
            # components are nodes of the new edges, so what was merged before is not looked at again
            at = lambda c: self._labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
            moved = self._edges.join(at("u"), "u").join(at("v"), "v").select(F.col("u_in").alias("u"), F.col("v_in").alias("v"))
            if self._merged:
                moved = moved.unionByName(self._spark.createDataFrame(list(self._merged.items()), "u long, v long"))
            roots = component_stars(moved).select(F.col("u").alias("component"), F.col("v").alias("root"))
            labels = self._labels.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            self._labels, self._edges, self._merged = materialize(labels, "labels"), None, {}
        return self._labels

    @property
    def labels(self) -> DataFrame:
        """(node, component)."""
        if self._merged and self._edges is None:
            self._edges = self._spark.createDataFrame([], "u long, v long")
        return self._settle()

    def find(self, x: int) -> int:
        self._check(x)
        root = self._settle().filter(F.col("node") == x).head()["component"]
        while root in self._merged:
            root = self._merged[root]
        return root

    def connected(self, x: int, y: int) -> bool:
        return self.find(x) == self.find(y)

    @property
    def n_components(self) -> int:
        return self._settle().filter("node = component").count() - len(self._merged)

    def __len__(self) -> int:
        return self.n

    def __repr__(self) -> str:
        return f"DisjointSets(n={self.n}, n_components={self.n_components})"
