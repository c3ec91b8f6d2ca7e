"""Fuzzy line deduplication by MinHash.

A line's id is the XXH64 of its bytes. Each distinct line, lower-cased and with its white space
collapsed, gets a min-wise signature of its ``SHINGLE``-character shingles, bands of it name
candidates, the exact Jaccard similarity of the shingle sets decides (``near.py``), and of every
component of alike lines, which a distributed union-find gives, only the first is kept, by (doc_id, text's hash, line number). Blank lines stay.

Texts are never shuffled for the comparison: ids and keys are, and the texts of candidate lines. Lines are taken as equal by 128 bits,
the id and a second hash.

Defined results: a null text has no lines and stays null; a null doc_id comes first; rows that
repeat a doc_id, null included, are documents of their own unless they repeat the text too; of equal lines in one document the first stays; lines shorter than a shingle
are one shingle; very long texts and lines are compared whole; empty tables give empty results; other columns are kept in a struct, where no name clashes.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize
from fusewright.llm.common import ByteCache, let, map_batches, utf8
from fusewright.llm.near import BLOCKS, band_keys, cached, common_ends, fetch_by_id, key_blocks, may_hold, mix32, n_buckets, similar_stars, sorted_set, surely_alike, with_sketches

SHINGLE, SIMILARITY = 7, 0.8
CHUNK = 512
SEED = 42  # of Spark's xxhash64
CHECK = 7  # hashed before a line, it makes the second hash
CHECK_SEED = xxhash.xxh64_intdigest(CHECK.to_bytes(4, "little"), SEED)
_B, _B2, _B3 = (np.uint32(0x01000193**k % (1 << 32)) for k in (1, 2, 3))


def normalise(line: str) -> str:
    return " ".join(line.lower().split())


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all shingles of normalised lines, and the line of each."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c) - SHINGLE + 1
    two = c[:-1] * _B + c[1:]
    four = two[:-2] * _B2 + two[2:]
    three = two[:-1] * _B + c[2:]
    h = four[:n] * _B3 + three[4 : 4 + n]  # seven characters
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.arange(n) + SHINGLE <= ends[owner]  # no shingle crosses into the next line
    return mix32(h[inside]), owner[inside]


def shingle_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys of normalised lines."""
    return band_keys(*shingle_hashes(lines), len(lines))


def shingles(line: str) -> set[str]:
    """Shingles of a line as written, once normalised."""
    line = normalise(line)
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


class _Line:
    """A line to compare. Shingles of characters below 512 are seven times nine bits of one number, so they are compared exactly as numbers."""

    def __init__(self, line: str):
        self.text = normalise(line)

    @property
    def nbytes(self) -> int:
        """With the numbers, which may come later."""
        return 12 * len(self.text)

    @cached_property
    def numbers(self) -> np.ndarray | None:
        c = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(c) - SHINGLE + 1
        if n < 1 or c.max() >= 512:
            return None
        two = c[:-1] << np.uint64(9) | c[1:]
        four = two[:-2] << np.uint64(18) | two[2:]
        three = two[:-1] << np.uint64(9) | c[2:]
        return sorted_set(four[:n] << np.uint64(27) | three[4 : 4 + n])

    def meets(self, other: _Line) -> tuple[int, int, int]:
        """Numbers of shingles of both, of this one and of the other."""
        a, b = self.numbers, other.numbers
        if a is not None and b is not None:
            both = np.sort(np.concatenate((a, b)))
            return int((both[1:] == both[:-1]).sum()), len(a), len(b)
        x, y = shingles(self.text), shingles(other.text)
        return len(x & y), len(x), len(y)


def alike(x: str, y: str, n: int, m: int, cache: ByteCache) -> bool:
    """Whether the exact Jaccard similarity of the shingle sets is at least ``SIMILARITY``; n, m: elements that the sets have at least."""
    p, q = cached(cache, x, _Line), cached(cache, y, _Line)
    start, end = common_ends(p.text, q.text)
    # shingles that touch what differs
    if surely_alike(n, m, *(len(z.text) - start - end + SHINGLE - 1 for z in (p, q)), SIMILARITY):
        return True
    both, a, b = p.meets(q)
    return both >= SIMILARITY * (a + b - both)


def lines_of(docs: DataFrame) -> DataFrame:
    """row_key (of doc_id and text), doc_id, line (number), id, check and body of each line."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    return rows.select("row_key", "doc_id", "line", F.xxhash64("body").alias("id"), F.xxhash64(F.lit(CHECK), "body").alias("check"), "body")


def _keys(docs: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found: dict[bytes, str] = {}
        for raw in utf8(batch.column("text")):
            for x in raw.split(b"\n"):
                if x and x not in found and not x.isspace():
                    found[x] = normalise(x.decode())
        if not found:
            return None
        ids = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), np.uint64, len(found)).view(np.int64)
        lines = list(found.values())
        keys = np.concatenate([shingle_keys(lines[k : k + CHUNK]) for k in range(0, len(lines), CHUNK)])
        return key_blocks(keys, ids, buckets)

    buckets = n_buckets(docs)
    return map_batches(docs.select("text"), work, BLOCKS)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    def bodies(wanted: Broadcast) -> DataFrame:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            lines = list(dict.fromkeys(x for raw in utf8(batch.column("text")) for x in raw.split(b"\n")))
            ids = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in lines), np.uint64, len(lines)).view(np.int64)
            at = np.flatnonzero(may_hold(wanted.value, ids))
            if not len(at):
                return None
            found = [lines[k] for k in at]
            check = np.fromiter((xxhash.xxh64_intdigest(x, CHECK_SEED) for x in found), np.uint64, len(found)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(check), pa.array(found, pa.binary()).cast(pa.string())], ["id", "check", "body"])

        return map_batches(docs.select("text"), work, "id long, check long, body string")

    return with_sketches(fetch_by_id(bodies, ids), "string", lambda lines: shingle_hashes([normalise(x) for x in lines]))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, removed): the numbers (from 0) of the lines that go, for documents that lose any."""
    seen = materialize(lines_of(docs).filter(F.col("body").rlike(r"[^\x20\x09-\x0D]")).drop("body"), "lines")
    classes = similar_stars(_keys(docs), lambda ids: _texts(docs, ids), alike, SIMILARITY)
    counts = seen.groupBy("id", "check").agg(F.count("*").alias("n")).join(classes.hint("shuffle_hash"), ["id", "check"], "left")
    # most lines are alone: only those that are repeated or like another go on
    of_class = F.struct(F.coalesce("root", "id").alias("root"), F.when(F.col("root").isNull(), F.col("check")).otherwise(0).alias("check"), F.col("root").isNull().alias("equal"))
    several = materialize(counts.filter("n > 1 OR root IS NOT NULL").select("id", "check", of_class.alias("class")), "several")
    places = materialize(seen.join(several.hint("shuffle_hash"), ["id", "check"]).select("class", "doc_id", "row_key", "line"), "places")
    firsts = materialize(places.groupBy("class").agg(F.min(F.struct("doc_id", "row_key", "line")).alias("kept")), "firsts")
    again = places.join(firsts.hint("shuffle_hash"), "class")
    again = again.filter(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("row_key") == F.col("kept.row_key")) & (F.col("line") == F.col("kept.line"))))
    return again.groupBy("row_key", "doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))  # at most a document's own lines


def _without(parts: Column, removed: Column) -> Column:
    """The lines between those removed, each stretch copied once."""
    ends = F.concat(F.array(F.lit(-1)), removed)
    between = lambda p, r: F.transform(r, lambda x, i: F.slice(p, x + 2, F.coalesce(F.get(r, i + 1), F.size(p)) - x - 1))
    return let(parts, lambda p: let(ends, lambda r: F.array_join(F.flatten(between(p, r)), "\n")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per document: row (its columns, with the text of the lines that stay), n_lines and removed (line numbers)."""
    gone = materialize(removed_lines(docs), "removed").select(F.col("row_key").alias("gone_key"), F.col("doc_id").alias("gone_id"), "removed")
    # a shuffled join at every size, as what goes grows with the documents; hashed, so that texts need no sort
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.struct("*").alias("row"))
    joined = rows.join(gone.hint("shuffle_hash"), (F.col("row_key") == F.col("gone_key")) & F.col("row.doc_id").eqNullSafe(F.col("gone_id")), "left")
    parts = F.split(F.col("row.text"), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(_without(parts, F.col("removed")))
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(parts))
    return joined.select(F.col("row").withField("text", text).alias("row"), n_lines.alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents' rows with the lines that stay."""
    return dedup_lines(docs).select("row.*")
