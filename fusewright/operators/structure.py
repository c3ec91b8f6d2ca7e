"""The graph between groups, its queries, and its construction from observations."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions.ordering import in_parts, running, with_chunk, with_rank
from fusewright.functions.schemas import require, spine
from fusewright.functions.storage import materialize
from fusewright.functions.validation import check_index, positive_int
from fusewright.operators.group_stats import infer_n_groups
from fusewright.operators.location import location
from fusewright.operators.pairs import canonicalize, check_fusion_pairs, infer_n_params
from fusewright.operators.weights import adaptive_weights, uniform_weights


#: Entries of a block of columns in ``CompressedRows``, and neighbours in a chunk of a list.
BLOCK_ENTRIES, CHUNK_NEIGHBOURS = 1 << 16, 1 << 12


class CompressedRows:
    """Adjacency in compressed rows: ``pointers`` (node, start, stop) and the columns (nbr and weight by node and nbr) in ``blocks`` of bounded size.

    Entries are numbered by ranges with offsets, and pointers are a running sum of degrees in two levels, so no task holds all nodes or a hub. Blocks are written in order,
    so a filter on their number reads few files.
    """

    def __init__(self, adjacency: DataFrame, n_params: int, block: int = BLOCK_ENTRIES):
        self.n_params, self.block, spark = n_params, positive_int(block, "block"), adjacency.sparkSession
        entries = with_rank(adjacency, ["node", "nbr"], "position")
        held = entries.groupBy(F.floor(F.col("position") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("position", "nbr", "weight"))).alias("e"))
        blocks = held.select("block", F.transform("e", lambda e: e["nbr"]).alias("nbrs"), F.transform("e", lambda e: e["weight"]).alias("weights"))
        self.blocks = materialize(blocks.repartitionByRange("block").sortWithinPartitions("block"), "blocks")
        degrees = adjacency.groupBy("node").agg(F.count("*").alias("degree"))
        every = spine(spark, n_params, "node").join(degrees, "node", "left").select(F.lit(0).alias("all_"), "node", F.coalesce("degree", F.lit(0)).alias("degree"))
        upto = running(in_parts(every, "all_", "node"), "all_", "node", {"stop": ("sum", F.col("degree"))})
        self.pointers = materialize(upto.select("node", (F.col("stop") - F.col("degree")).alias("start"), "stop").repartitionByRange("node").sortWithinPartitions("node"), "pointers")

    def _cut(self, pointed: DataFrame, blocks: DataFrame) -> DataFrame:
        """node, nbr and weight of rows of ``pointers``."""
        first, last = (F.floor(F.col(c) / self.block).cast("long") for c in ("start", "last"))
        asked = pointed.filter("stop > start").withColumn("last", F.col("stop") - 1).withColumn("block", F.explode(F.sequence(first, last)))
        begin = F.col("block") * self.block
        low, high = F.greatest(F.col("start") - begin, F.lit(0)), F.least(F.col("stop") - begin, F.lit(self.block))
        part = lambda c: F.slice(c, (low + 1).cast("int"), (high - low).cast("int"))
        return asked.join(blocks, "block").select("node", F.explode(F.arrays_zip(part("nbrs").alias("nbr"), part("weights").alias("weight"))).alias("e")).select("node", "e.nbr", "e.weight")

    def neighbor_data(self, node: int) -> DataFrame:
        """nbr and weight by nbr, from the blocks that the node's pointers name."""
        check_index(node, self.n_params)
        at = self.pointers.filter(F.col("node") == node).head()
        blocks = self.blocks.filter((F.col("block") >= at["start"] // self.block) & (F.col("block") <= max(at["start"], at["stop"] - 1) // self.block))
        return self._cut(self.pointers.filter(F.col("node") == node), blocks).select("nbr", "weight").orderBy("nbr")

    def rows(self) -> DataFrame:
        """node, nbr and weight of all entries, cut from the blocks."""
        return self._cut(self.pointers, self.blocks)


class FusionGraph:
    """Canonical weighted pairs over nodes 0 to ``n_params`` - 1, as lazy tables."""

    def __init__(self, pairs: DataFrame, n_params: int | None = None, how: str = "first", validate: bool = True, canonical: bool = False):
        """canonical: the pairs are so already (u < v, one row each), as a chain's are, and need no merging; only without ``validate``."""
        if canonical and not validate:
            self.pairs = require(pairs, "u", "v", "weight")
            self.n_params = infer_n_params(self.pairs) if n_params is None else n_params
        elif validate:
            self.pairs, self.n_params = check_fusion_pairs(pairs, n_params, how)
        else:
            self.pairs = canonicalize(pairs, how)
            self.n_params = infer_n_params(self.pairs) if n_params is None else n_params
        self._spark = pairs.sparkSession

    @cached_property
    def adjacency(self) -> DataFrame:
        """node, nbr and weight, both ways."""
        way = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("nbr"), "weight")
        return self.pairs.select(F.explode(F.array(way("u", "v"), way("v", "u"))).alias("e")).select("e.*")

    @cached_property
    def n_pairs(self) -> int:
        return self.pairs.count()

    def neighbor_data(self, node: int) -> DataFrame:
        """nbr and weight by nbr, from the node's pairs alone."""
        check_index(node, self.n_params)
        own = self.pairs.filter((F.col("u") == node) | (F.col("v") == node))
        return own.select(F.when(F.col("u") == node, F.col("v")).otherwise(F.col("u")).alias("nbr"), "weight").orderBy("nbr")

    def neighbors(self, node: int) -> list[int]:
        return [r["nbr"] for r in self.neighbor_data(node).collect()]

    def neighbor_weights(self, node: int) -> list[float]:
        return [r["weight"] for r in self.neighbor_data(node).collect()]

    def degree(self, node: int) -> int:
        return self.neighbor_data(node).count()

    def _padded(self, per_node: DataFrame) -> DataFrame:
        return spine(self._spark, self.n_params, "node").join(per_node, "node", "left")

    def degrees(self) -> DataFrame:
        counts = self.adjacency.groupBy("node").agg(F.count("*").alias("degree"))
        return self._padded(counts).select("node", F.coalesce("degree", F.lit(0)).alias("degree"))

    def adjacency_list(self) -> DataFrame:
        """node and nbrs, an array of (nbr, weight); empty for isolated nodes."""
        lists = self.adjacency.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nbr", "weight"))).alias("nbrs"))
        return self._padded(lists).select("node", F.coalesce("nbrs", F.array().cast("array<struct<nbr:bigint,weight:double>>")).alias("nbrs"))

    def adjacency_map(self) -> DataFrame:
        """node and nbrs, a map from nbr to weight."""
        return self.adjacency_list().select("node", F.map_from_entries("nbrs").alias("nbrs"))

    def adjacency_chunks(self, size: int = CHUNK_NEIGHBOURS) -> DataFrame:
        """node, chunk (from 0) and nbrs, at most ``size`` (nbr, weight) by nbr: the lists in rows of bounded size, one after another. Isolated nodes have none."""
        chunked = with_chunk(self.adjacency, "node", "nbr", positive_int(size, "size"))
        return chunked.groupBy("node", "chunk").agg(F.array_sort(F.collect_list(F.struct("nbr", "weight"))).alias("nbrs"))

    def compressed_rows(self, block: int = BLOCK_ENTRIES) -> CompressedRows:
        return CompressedRows(self.adjacency, self.n_params, block)

    def indexed_pairs(self) -> DataFrame:
        """Adds pair_idx in order of (u, v)."""
        return with_rank(self.pairs, ["u", "v"], "pair_idx")

    def incidence(self, weighted: bool = True) -> DataFrame:
        """node, pair_idx and value: +w at u and -w at v (or +1 and -1)."""
        w = F.col("weight") if weighted else F.lit(1.0)
        ends = F.array(F.struct(F.col("u").alias("node"), w.alias("value")), F.struct(F.col("v").alias("node"), (-w).alias("value")))
        return self.indexed_pairs().select("pair_idx", F.explode(ends).alias("e")).select("e.node", "pair_idx", "e.value")

    def pair_differences(self, theta: DataFrame, weighted: bool = True) -> DataFrame:
        """pair_idx and difference: the incidence matrix's transpose times theta."""
        joined = self.incidence(weighted).join(theta.select(F.col("group_id").alias("node"), "theta"), "node")
        return joined.groupBy("pair_idx").agg(F.sum(F.col("value") * F.col("theta")).alias("difference"))

    def __len__(self) -> int:
        return self.n_params

    def __repr__(self) -> str:
        mean = 2 * self.n_pairs / self.n_params if self.n_params else 0.0
        return f"FusionGraph(n_params={self.n_params}, n_pairs={self.n_pairs}, mean_degree={mean:.2f})"


def build_graph(obs: DataFrame, pairs: DataFrame, *, n_groups: int | None = None, weighted: bool = False, adaptive: bool = True, method: str = "mean", gamma: float = 1.0, w_max: float | None = None, how: str = "first", validate: bool = True) -> FusionGraph:
    """A graph from observations: ``weighted`` pairs keep their weights; else adaptive ones from group estimates, or 1."""
    n = n_groups
    if not weighted:
        if adaptive:
            theta = location(obs, method, n_groups, validate=validate)
            pairs = adaptive_weights(pairs, theta, gamma, w_max)
        else:
            pairs = uniform_weights(pairs)
    return FusionGraph(pairs, infer_n_groups(obs) if n is None else n, how, validate)
