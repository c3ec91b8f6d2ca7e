"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: a bit of the 64 is set if it is set in over half of the hashes of a text's
word shingles. Equal fingerprints are grouped first, so copies cost nothing more.

Blocks: the 64 bits are cut into ``radius + 2`` bands; fingerprints within the radius
agree in at least two of them, so every pair meets in a block keyed by two bands. A block
of over ``BLOCK`` fingerprints is cut again by the bands of its other bits, of which
``radius + 1`` suffice, until the bits left bound its size.

In a block the fingerprints are stored as bit planes. All distances from a group of queries
advance one plane at a time in carry-save counters of a few words per 64 lanes, and a group
is abandoned once every lane is past the radius.

``similar_classes`` joins the texts whose fingerprints are within ``NEAR_RADIUS`` by the same blocks and bit planes, where the exact Jaccard similarity
of their shingles confirms it. No radius of majority bits bounds that similarity, so an exact way for the rest follows: what the fingerprints leave apart meets in
min-wise bands and is compared by parity sketches, whose distance bounds that of the shingle sets, and by the exact similarity again (``near.py``).

Defined results: a null text has no words; texts without words have fingerprint zero; texts
shorter than a shingle are one shingle; very long texts are read whole; rows that repeat a doc_id keep their own fingerprint and
share nothing else; a null doc_id never names a component unless all are null; empty tables give
empty results; other columns are ignored or carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize
from fusewright.llm.common import ByteCache, map_batches, ship, utf8
from fusewright.llm.near import BLOCKS, band_keys, cached, fetch_by_id, key_blocks, may_hold, mix32, n_buckets, similar_stars, sorted_set, with_sketches
from fusewright.operators.components import component_stars

BITS = 64
BLOCK = 2048
QUERIES = 64
LANES = 1 << 16
SEED, CHECK_SEED = 42, 7
#: Differing bits of the fingerprints that ``similar_classes`` links before it looks for what is farther apart.
NEAR_RADIUS = 3


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included; A-Z is lower-cased."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and fp of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(shingle_hashes(t, width)) for t in utf8(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words; lane k of row b is bit b of fingerprint k."""
    words = -(-len(fps) // 64)
    lanes = np.zeros(words * 64, np.uint64)
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _past(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius: a comparison with a constant, from the highest counter plane down."""
    above, equal = np.zeros_like(over), ~np.zeros_like(over)
    for j in reversed(range(len(counters))):
        if radius >> j & 1:
            equal &= counters[j]
        else:
            above |= equal & counters[j]
            equal &= ~counters[j]
    return over | above


def within(planes: np.ndarray, masks: np.ndarray, radius: int, over: np.ndarray | None = None) -> np.ndarray | None:
    """Lanes (as words) within the radius. planes: (64, words); masks: (64, queries), all ones where the query's bit is set; over: lanes not to look at.

    None once every lane of the group is past the radius.
    """
    shape = (masks.shape[1], planes.shape[1])
    counters = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(shape, np.uint64) if over is None else over.copy()
    for b in range(BITS):
        carry = planes[b][None, :] ^ masks[b][:, None]
        for c in counters:
            carry, c[...] = c & carry, c ^ carry
        over |= carry
        if b % 8 == 7 and not (~_past(counters, over, radius)).any():
            return None
    return ~_past(counters, over, radius)


def block_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i > j) of one block's fingerprints within the radius."""
    planes = bit_planes(fps)
    left, right = [], []
    step = max(1, min(QUERIES, LANES // planes.shape[1]))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for q in range(0, len(fps), step):
        bits = np.unpackbits(fps[q : q + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        words = min((q + step + 63) // 64, planes.shape[1])  # only lanes up to the queries
        later = np.arange(64 * words)[None, :] >= np.arange(q, q + len(bits))[:, None]  # the query itself and those after it
        lanes = within(planes[:, :words], np.where(bits.T, full, np.uint64(0)), radius, np.packbits(later, axis=1, bitorder="little").view(np.uint64))
        if lanes is None:
            continue
        i, j = np.nonzero(np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little"))
        left.append(i + q)
        right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def pair_links(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs are within the radius; each pair is a lane of the difference's bit planes."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), LANES):
        planes = bit_planes(a[k : k + LANES] ^ b[k : k + LANES])
        lanes = within(planes, np.zeros((BITS, 1), np.uint64), radius)
        if lanes is not None:
            out[k : k + LANES] = np.unpackbits(lanes.view(np.uint8).ravel(), bitorder="little")[: len(a[k : k + LANES])]
    return out


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(bits: list[int], parts: int) -> list[int]:
    return [sum(1 << b for b in chunk.tolist()) for chunk in np.array_split(np.array(bits), parts)]


def block_masks(radius: int) -> list[int]:
    """Masks of two bands each: fingerprints within the radius agree under at least one."""
    return [a | b for a, b in combinations(_cut(list(range(BITS)), radius + 2), 2)]


def finer_masks(masks: list[int], radius: int) -> list[tuple[int, int]]:
    """(index of the mask, mask) with one more band of the bits that the mask leaves, of which radius + 1 suffice."""
    return [(k, m | part) for k, m in enumerate(masks) for part in _cut([b for b in range(BITS) if not m >> b & 1], radius + 1) if part]


def fingerprint_links(distinct: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that span every block's links; ``distinct`` has one column fp of distinct values."""
    spark = distinct.sparkSession
    ship(spark)
    masks = [(0, m) for m in block_masks(radius)]
    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, (_, m) in enumerate(masks)])).alias("x")).select("fp", "x.*")
    found = None
    while True:
        counts = materialize(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), "blocks")
        members = rows.join(counts, ["mask", "key"])
        last = all(BITS - m.bit_count() <= 15 for _, m in masks)
        links = _links_in_blocks(members if last else members.filter(F.col("n") <= block), radius)
        found = links if found is None else found.unionByName(links)
        if last or counts.filter(F.col("n") > block).isEmpty():
            return found
        finer = finer_masks([m for _, m in masks], radius)
        options = F.array(*[F.struct(F.lit(parent).alias("parent"), F.lit(k).alias("m2"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k2")) for k, (parent, m) in enumerate(finer)])
        hot = materialize(members.filter(F.col("n") > block).select("fp", "mask"), "hot")
        rows = hot.select("fp", "mask", F.explode(F.filter(options, lambda o: o["parent"] == F.col("mask"))).alias("x")).select("fp", F.col("x.m2").alias("mask"), F.col("x.k2").alias("key"))
        masks = finer


def _links_in_blocks(members: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("mask").to_numpy(), b.column("key").to_numpy(), b.column("fp").to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        mask, key, fp = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((fp, key, mask))
        mask, key, fp = mask[order], key[order], fp[order]
        both = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
        size = np.diff(np.append(both, len(key)))
        bits = fp.view(np.uint64)
        for n in np.unique(size[(size > 1) & (size <= 32)]):
            at = both[size == n]
            i, j = np.triu_indices(n, 1)
            for k in range(0, len(at), max(1, LANES // len(i))):
                some = at[k : k + max(1, LANES // len(i))]
                a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                ok = pair_links(bits[a], bits[b], radius)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(fp[a[ok]]), pa.array(fp[b[ok]])], ["u", "v"])
        for s, n in zip(both[size > 32], size[size > 32]):
            i, j = block_links(bits[s : s + n], radius)
            if len(i):
                # each with its least neighbour before it, and neighbours chained: as many edges as members, the same components
                order = np.lexsort((j, i))
                i, j = i[order], j[order]
                first = np.concatenate(([True], i[1:] != i[:-1]))
                a, b = np.concatenate((i[first], j[1:][~first[1:]])), np.concatenate((j[first], j[:-1][~first[1:]]))
                edges = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(fp[s + edges[0]]), pa.array(fp[s + edges[1]])], ["u", "v"])

    return members.select("mask", "key", "fp").repartition("mask", "key").mapInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links of at most ``radius`` bits) of each row."""
    rows = materialize(fingerprints(docs, width), "fingerprints")
    firsts = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    stars = component_stars(fingerprint_links(firsts.select("fp"), radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = firsts.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialize(rooted.join(materialize(least, "least"), "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def _words(raw: bytes) -> bytes:
    return b" ".join(raw.lower().split())


def _text_id(words: bytes, seed: int = SEED) -> int:
    h = xxhash.xxh64_intdigest(words, seed)
    return h - (1 << 64) if h >> 63 else h


def _short(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint32) ^ (h >> np.uint64(32)).astype(np.uint32)


def _similar_keys(docs: DataFrame, width: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = {_text_id(w): w for t in utf8(batch.column("text")) if (w := _words(t))}
        if not texts:
            return None
        hashes = [shingle_hashes(w, width) for w in texts.values()]
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        keys = band_keys(mix32(_short(np.concatenate(hashes))), owner, len(hashes))
        return key_blocks(keys, np.array(list(texts), np.int64), buckets)

    buckets = n_buckets(docs)
    return map_batches(docs.select("text"), work, BLOCKS)


def _similar_bodies(docs: DataFrame, wanted: Broadcast) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = {_text_id(w): w for t in utf8(batch.column("text")) if (w := _words(t))}
        ids = np.array(list(texts), np.int64)
        at = np.flatnonzero(may_hold(wanted.value, ids))
        if not len(at):
            return None
        bodies = list(texts.values())
        found = [bodies[k] for k in at]
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([_text_id(w, CHECK_SEED) for w in found], pa.int64()), pa.array(found, pa.binary())], ["id", "check", "body"])

    return map_batches(docs.select("text"), work, "id long, check long, body binary")


def _fingerprint_pairs(rows: DataFrame, radius: int) -> DataFrame:
    """Pairs (a > b) of ids that join all texts whose fingerprints are reachable within the radius. rows: id and fp, null where a text has no words."""
    texts = materialize(rows.filter("fp IS NOT NULL").select("fp", "id").distinct(), "fingerprints")
    firsts = materialize(texts.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    same = texts.join(firsts.hint("shuffle_hash"), "fp").select(F.col("id").alias("x"), F.col("first").alias("y"))
    links = fingerprint_links(firsts.select("fp"), radius)
    for end, name in (("u", "x"), ("v", "y")):
        links = links.join(firsts.select(F.col("fp").alias(end), F.col("first").alias(name)).hint("shuffle_hash"), end)
    pairs = same.unionByName(links.select("x", "y")).filter("x <> y")
    return materialize(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "linked")


def similar_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """row_key (of doc_id and text), doc_id, class_id (its smallest doc_id), kept_key and kept_id (row_key and doc_id that stand for the class) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def identify(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [_words(t) for t in utf8(batch.column("text"))]
        hashes = [pa.array([_text_id(w, seed) for w in words], pa.int64()) for seed in (SEED, CHECK_SEED)]
        fps = pa.array([fingerprint(shingle_hashes(w, width)) if w else None for w in words], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), *hashes, fps], ["row_key", "doc_id", "id", "check", "fp"])

    def distinct(words: bytes) -> np.ndarray:
        return sorted_set(shingle_hashes(words, width))

    def alike(x: bytes, y: bytes, n: int, m: int, cache: ByteCache) -> bool:
        a, b = cached(cache, x, distinct), cached(cache, y, distinct)
        if min(len(a), len(b)) < similarity * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= similarity * (len(a) + len(b) - both)

    def sets(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes = [shingle_hashes(x, width) for x in bodies]
        return _short(np.concatenate(hashes)), np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])

    def fetch(ids: DataFrame) -> DataFrame:
        return with_sketches(fetch_by_id(lambda wanted: _similar_bodies(docs, wanted), ids), "binary", sets)

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text")
    rows = materialize(map_batches(keyed, identify, f"row_key long, doc_id {kind}, id long, check long, fp long"), "rows")
    classes = similar_stars(_similar_keys(docs, width), fetch, alike, similarity, _fingerprint_pairs(rows, NEAR_RADIUS))
    firsts = rows.groupBy("id", "check").agg(F.min(F.struct("doc_id", "row_key")).alias("first")).join(classes.hint("shuffle_hash"), ["id", "check"], "left")
    of_class = F.struct(F.coalesce("root", "id").alias("root"), F.when(F.col("root").isNull(), F.col("check")).otherwise(0).alias("check"), F.col("root").isNull().alias("equal"))
    rooted = materialize(firsts.select("id", "check", "first", of_class.alias("class")), "rooted")
    kept = materialize(rooted.groupBy("class").agg(F.min("first").alias("kept")), "kept")
    named = rooted.join(kept.hint("shuffle_hash"), "class").select("id", "check", F.col("kept.doc_id").alias("class_id"), F.col("kept.row_key").alias("kept_key"))
    return rows.join(materialize(named, "classes").hint("shuffle_hash"), ["id", "check"]).select("row_key", "doc_id", "class_id", "kept_key", F.col("class_id").alias("kept_id"))


def remove_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of one document per class of near-duplicates: the one with the smallest doc_id. Of rows equal in doc_id and text one stays."""
    stand = (F.col("row_key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    stays = similar_classes(docs, width, similarity).filter(stand).groupBy(F.col("row_key").alias("stay_key"), F.col("doc_id").alias("stay_id")).agg(F.count("*").alias("times"))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.struct("*").alias("row"))
    # a shuffled join at every size, as what stays grows with the documents
    kept = keyed.join(materialize(stays, "stays").hint("shuffle_hash"), (F.col("row_key") == F.col("stay_key")) & F.col("row.doc_id").eqNullSafe(F.col("stay_id")))
    again = kept.filter("times > 1").withColumns({"a": F.col("row.doc_id"), "b": F.col("row.text")}).dropDuplicates(["a", "b"])
    return kept.filter("times = 1").select("row.*").unionByName(again.select("row.*"))
