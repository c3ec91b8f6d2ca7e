"""Near-duplicate embeddings: a subspace pigeonhole join within labels, exact.

Unit vectors of cosine t or more are at most sqrt(2 - 2 t) apart. They are rotated, so that no few dimensions hold the distance, and split into
blocks of ``WIDTH`` dimensions. A block of w of d dimensions has the share w / d of the squared distance as its budget: a pair within the whole distance
is within the budget of one block at least. Each block is range-joined under its budget, the union of the blocks' pairs is verified by cosine.

Range join: a block's space is cut into cells by a k-d tree for each label, fitted on a bounded sample (``SAMPLE`` rows), which decides speed only. A vector is at
home in one cell and visits later cells that its ball of the block's radius touches, so a pair meets in one cell of a block.
Cells over ``CHUNK`` rows are dealt as pairs of chunks by the counted sizes, so no task holds a hot label, a hot cell or a large group of near copies.

In a task all distances of two chunks are taken by matrix products, tile by tile. A pair belongs to the first block whose budget it meets, so it is verified and counted
once in the whole job without a list of pairs ever being made: a task returns a link count for each vector, and edges that span its links.
Coordinates are integers, the rotation too, and all products stay below 2**53, so every task finds the same distances and the same owner; what rounding may
add to a distance is added to the budgets.

Equal vectors of a label are one vector with a weight. Links of a large group of vectors that are near but not equal cost the square of its size in products, as each one's count
asks for that, in tasks of bounded size.

Defined results: rows whose label is null, or whose vector is null, empty, zero or has null or non-finite components, link with nothing, nor do vectors of different lengths;
rows that repeat a vec_id are vectors of their own; a null vec_id never names a component unless all are null; ties have no order to decide; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize
from fusewright.llm.alignment import union_find
from fusewright.llm.common import map_batches, ship
from fusewright.operators.components import component_stars

WIDTH = 8
#: Rows that the trees are fitted on, rows a cell should hold, and rows of a side that meet in one task.
SAMPLE, LEAF, CHUNK = 100_000, 1024, 2048
#: Of a cut's rows, the share within the radius of it from which it is not made.
CROWDED = 0.6
TILE = 256
SCALE = float(1 << 12)
CELL = ("label", "dim", "block", "leaf")

Tree = tuple | int


@lru_cache
def bounds(d: int) -> list[tuple[int, int]]:
    """First and last dimension of each block."""
    cuts = np.linspace(0, d, max(1, round(d / WIDTH)) + 1).astype(int).tolist()
    return list(zip(cuts, cuts[1:]))


@lru_cache(maxsize=4)
def rotation(d: int) -> np.ndarray:
    """An orthogonal matrix times ``SCALE``, of integers."""
    q, _ = np.linalg.qr(np.random.RandomState(d).standard_normal((d, d)))  # noqa: NPY002  a fixed rotation
    return np.rint(q * SCALE)


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotated(units: np.ndarray) -> np.ndarray:
    """Integers, about ``SCALE`` squared times the rotated vectors."""
    return np.rint(units * SCALE) @ rotation(units.shape[1])


@lru_cache(maxsize=16)
def budgets(d: int, similarity: float) -> list[float]:
    """Squared radius of each block, for ``rotated`` coordinates."""
    turn = rotation(d)
    stretch = np.sqrt(np.abs(np.linalg.eigvalsh(turn @ turn.T)).max())  # SCALE, and a little for rounding
    whole = stretch * (SCALE * np.sqrt(max(0.0, 2 - 2 * similarity) + 1e-9) + np.sqrt(d))
    return [whole * whole * (e - s) / d * (1 + 1e-9) for s, e in bounds(d)]


def grow(sample: np.ndarray, rows: float, radius: float, leaves: list[int]) -> Tree:
    """A tree of (dimension, cut, below, from the cut on); leaves are numbered in order. rows: how many the sample stands for."""
    if rows > LEAF and len(sample) >= 16:
        best = None
        for k, column in enumerate(sample.T):
            for at in (0.5, 0.4, 0.6, 0.3, 0.7):
                cut = float(np.floor(np.quantile(column, at)))
                below = float((column < cut).mean())
                cost = float((np.abs(column - cut) <= radius).mean()) + abs(below - 0.5)
                if 0 < below < 1 and (best is None or cost < best[0]):
                    best = cost, k, cut
        if best is not None and best[0] <= CROWDED:
            _, k, cut = best
            side = sample[:, k] < cut
            share = rows / len(sample)
            return k, cut, grow(sample[side], share * side.sum(), radius, leaves), grow(sample[~side], share * (~side).sum(), radius, leaves)
    leaves.append(len(leaves))
    return leaves[-1]


def places(tree: Tree, points: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, whether at home) of each row's own cell and of the later cells within the budget."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def walk(node: Tree, rows: np.ndarray, off: np.ndarray) -> None:
        """off: how far the rows are from the node's cell in each dimension."""
        if not len(rows):
            return
        if isinstance(node, int):
            out.append((rows, node, ~off.any(axis=1)))
            return
        k, cut, low, high = node
        beyond = points[rows, k] - cut
        under = beyond < 0
        for child, own, gap in ((low, under, beyond + 1), (high, ~under, -beyond)):  # coordinates are integers
            reach = off.copy()
            reach[~own, k] = np.maximum(reach[~own, k], gap[~own])
            near = own | ((reach * reach).sum(axis=1) <= budget)
            walk(child, rows[near], reach[near])

    walk(tree, np.arange(len(points)), np.zeros(points.shape))
    row = np.concatenate([r for r, _, _ in out])
    leaf = np.concatenate([np.full(len(r), x) for r, x, _ in out])
    home = np.concatenate([h for _, _, h in out])
    own = np.empty(len(points), np.int64)
    own[row[home]] = leaf[home]
    later = leaf >= own[row]
    return row[later], leaf[later], home[later]


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of both; exact, as these are integers."""
    return (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :] - 2 * (left @ right.T)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows with rows."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def owned_links(left: np.ndarray, right: np.ndarray | None, block: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of left, rows of right) of the links that ``block`` owns, tile by tile; without ``right`` of left's rows with earlier ones."""
    d = left.shape[1]
    budget, ends = budgets(d, similarity), bounds(d)
    u = unit(left)
    v = u if right is None else unit(right)
    x = rotated(u)
    y = x if right is None else rotated(v)
    for k in range(0, len(x), TILE):
        stop = min(len(x), k + TILE)
        others = stop if right is None else len(y)
        s, e = ends[block]
        near = _apart(x[k:stop, s:e], y[:others, s:e]) <= budget[block]
        if right is None:
            near &= np.arange(others)[None, :] < np.arange(k, stop)[:, None]
        i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(i):
            continue
        near = near[np.ix_(i, j)]
        i += k
        for (s, e), most in zip(ends[:block], budget):
            near &= _apart(x[i, s:e], y[j, s:e]) > most
        cos = u[i] @ v[j].T
        link = near & (cos >= similarity)
        close = np.nonzero(near & (np.abs(cos - similarity) < 1e-12))
        if len(close[0]):
            other = left if right is None else right
            link[close] = cosine(left[i[close[0]]].astype(np.float64), other[j[close[1]]].astype(np.float64)) >= similarity
        a, b = np.nonzero(link)
        if len(a):
            yield i[a], j[b]


def solve_group(block: int, id_: np.ndarray, weight: np.ndarray, vectors: np.ndarray, home: np.ndarray, second: np.ndarray, similarity: float) -> pa.RecordBatch | None:
    """(id, n, root): each linked row's number of links, and a row that it reaches in this group. second: rows of the other chunk, which meet only the others."""
    n = np.zeros(len(id_), np.int64)
    root = np.arange(len(id_))
    first = np.flatnonzero(home & ~second)
    rest = np.flatnonzero(second if second.any() else ~home)
    for left, right in (((first, None),) if not second.any() else ()) + (((first, rest),) if len(first) and len(rest) else ()):
        for a, b in owned_links(vectors[left], None if right is None else vectors[right], block, similarity):
            a, b = left[a], (left if right is None else right)[b]
            n += np.bincount(a, weight[b], len(n)).astype(np.int64) + np.bincount(b, weight[a], len(n)).astype(np.int64)
            root = union_find(len(n), np.concatenate((np.arange(len(n)), a)), np.concatenate((root, b)))
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(id_[at]), pa.array(n[at]), pa.array(id_[root[at]])], ["id", "n", "root"]) if len(at) else None


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _trees(distinct: DataFrame, similarity: float) -> dict[tuple, list[Tree]]:
    """Trees of each block for the labels of over ``LEAF`` rows in a sample of about ``SAMPLE`` rows."""
    n = distinct.count()
    share = min(1.0, SAMPLE / max(1, n))
    # a fixed choice by id; a few more than SAMPLE do no harm
    drawn = distinct.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else distinct
    taken = drawn.select("label", "dim", "vector").toArrow()
    found: dict[tuple, list[Tree]] = {}
    keys: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(taken.column("label").to_pylist(), taken.column("dim").to_pylist())):
        keys.setdefault(key, []).append(k)
    for (label, d), at in keys.items():
        if len(at) / share > LEAF:
            points = rotated(unit(_matrix(taken.column("vector").take(pa.array(at)).combine_chunks(), d)))
            budget = budgets(d, similarity)
            found[label, d] = [grow(points[:, s:e], len(at) / share, float(np.sqrt(budget[b])), []) for b, (s, e) in enumerate(bounds(d))]
    return found


def _placed(distinct: DataFrame, trees: Broadcast, similarity: float, vectors: bool) -> DataFrame:
    """A row for every cell of every block that a vector is at home in or visits."""
    kinds = dict(distinct.dtypes)
    carried = ["id", "n", "vector"] if vectors else []
    schema = f"label {kinds['label']}, dim int, block int, leaf int, home boolean" + (f", id long, n long, vector {kinds['vector']}" if vectors else "")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        label, dim = batch.column("label").to_pylist(), batch.column("dim").to_numpy()
        groups: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(label, dim.tolist())):
            groups.setdefault(key, []).append(k)
        parts: list[tuple] = []
        for key, at in groups.items():
            at = np.array(at)
            planted = trees.value.get(key)
            points = rotated(unit(_matrix(batch.column("vector").take(pa.array(at)), key[1]))) if planted else None
            for b, (s, e) in enumerate(bounds(key[1])):
                row, leaf, home = places(planted[b], points[:, s:e], budgets(key[1], similarity)[b]) if planted else (np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool))
                parts.append((at[row], np.full(len(row), b, np.int32), leaf.astype(np.int32), home))
        row, block, leaf, home = (np.concatenate(c) for c in zip(*parts))
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column("label").take(take), batch.column("dim").take(take), pa.array(block), pa.array(leaf), pa.array(home), *[batch.column(c).take(take) for c in carried]], [*CELL, "home", *carried])

    return map_batches(distinct, work, schema)


def _links(distinct: DataFrame, similarity: float) -> DataFrame:
    """(id, n, root): parts of the link counts, and edges that span the links."""
    trees = distinct.sparkSession.sparkContext.broadcast(_trees(distinct, similarity))  # bounded by the sample
    homes, visits = F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visits")
    large = materialize(_placed(distinct, trees, similarity, False).groupBy(*CELL).agg(homes, visits).filter(F.col("homes") + F.col("visits") > CHUNK), "cells")
    there = _placed(distinct, trees, similarity, True).join(large, [*CELL], "left")
    h, v = (F.coalesce(F.ceil(F.col(c) / CHUNK), F.lit(1)).cast("int") for c in ("homes", "visits"))
    whole = F.col("homes").isNull()
    spread = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    own = F.when(whole, 0).when(F.col("home"), spread(h)).otherwise(h + spread(v))
    # homes meet all chunks, visitors only those of homes
    others = F.when(whole, F.array(F.lit(0))).when(F.col("home"), F.sequence(F.lit(0), h + v - 1)).when(h > 0, F.sequence(F.lit(0), h - 1))
    dealt = there.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select(*CELL, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), "home", "id", "n", "vector")
    names = [*CELL, "low", "high"]

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(parts)
        first = rows.slice(0, 1).to_pylist()[0]
        column = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        second = column("second") if first["low"] < first["high"] else np.zeros(len(rows), bool)
        return solve_group(first["block"], column("id"), column("n"), _matrix(rows.column("vector").combine_chunks(), first["dim"]), column("home"), second, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:  # sorted, so a group's rows come together
            keys = list(zip(*[batch.column(c).to_pylist() for c in names]))
            cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if b == a:
                    continue
                if held and keys[a] != last:
                    if (out := solve(held)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
                last = keys[a]
        if held and (out := solve(held)) is not None:
            yield out

    ship(distinct.sparkSession)
    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "id long, n long, root long")


def similar_embeddings(vectors: DataFrame, similarity: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding, label); ``similarity`` is above zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", "embedding", usable.alias("usable"))
    distinct = rows.filter("usable").groupBy("label", F.col("embedding").alias("vector")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    distinct = materialize(distinct.withColumn("dim", F.size("vector")).withColumn("id", F.monotonically_increasing_id()), "vectors")
    links = materialize(_links(distinct.select("id", "label", "dim", "n", "vector"), similarity), "links")
    counts = links.groupBy("id").agg(F.sum("n").alias("links"))
    stars = component_stars(links.select(F.col("id").alias("u"), F.col("root").alias("v")).distinct()).select(F.col("u").alias("id"), F.col("v").alias("root"))
    named = distinct.select("id", "label", "vector", "n", "first").join(counts, "id", "left").join(stars, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = materialize(named, "rooted")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select(F.col("label").alias("l"), "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.filter("usable").join(named, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("vector"))).select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
