"""Removal of repeated substrings by merging shards' suffixes with interleave refinement.

Two suffixes repeat a string of ``LENGTH`` bytes if they stay in one block of the merged order for
that many rounds of refinement. Refining every suffix of the corpus for ``LENGTH`` rounds is
what a plain merge of the shards' Burrows-Wheeler transforms costs; here only anchored suffixes take part:

1. Every window of ``LENGTH`` bytes is named by the least hash among its ``GRAM``-byte
   substrings, its anchor. Equal windows have equal anchors at equal offsets, so only runs of windows
   whose anchor occurs twice can repeat. A run and its bytes form a slice, aligned at the anchor.
2. Equal slices repeat as they are and are counted, not compared.
3. The other slices meet by anchor, one copy each, from whatever shard they come. The merge
   starts with one block per anchor and refines by one column a round: to the right of the anchor
   (blocks of common prefixes by length) and to the left of it, as the transform's
   backward step does. Blocks with one suffix are settled and take no further part; a round sorts the live suffixes' block numbers with one
   symbol each, never suffixes.
4. A window's block is its right block and its left block together; blocks of two or more are the
   repeated intervals, from which the bytes to remove follow.

Anchors with more than ``HOT`` distinct slices are resolved by counting their windows' 128-bit digests
with partial aggregation, so no task holds a hot anchor.

Defined results: a null or empty text has no bytes and the digest of nothing; texts shorter than
``LENGTH`` lose nothing; very long texts are cut into overlapping segments and treated whole; rows that repeat a doc_id are documents of their own; rows equal in
doc_id and text get the same result, and as copies lose all windows; rows are named by 128 bits of doc_id and text; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize
from fusewright.llm.common import map_batches, ship, utf8
from fusewright.llm.near import mix

LENGTH, GRAM = 200, 64
SPAN = LENGTH - GRAM + 1
CHUNK = 1 << 20
BATCH = 20_000
HOT = 20_000
#: Two hashes of doc_id and text name a row.
KEY = ("dk", "dk2")


def _sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (n - size)], a[n - size :]) if size < n else a


def anchored_runs(buf: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, anchor's hash) of each run of windows with one anchor; places are in ``buf``, which joins texts that end at ``ends``."""
    if len(buf) < LENGTH:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    h = mix(np.frombuffer(buf, np.uint8).astype(np.uint64) + np.uint64(1))
    size, factor = 1, 0x9E3779B97F4A7C15
    while size < GRAM:  # GRAM is a power of two
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = size * 2, factor * factor % (1 << 64)
    h = mix(h)
    least = _sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), SPAN)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    window = np.arange(len(at))
    text = np.searchsorted(ends, window, side="right")
    whole = np.flatnonzero(window + LENGTH <= ends[text])
    if not len(whole):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    anchor = at[whole]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1] + 1))))
    first, last = whole[new], whole[np.append(new[1:], len(whole)) - 1]
    return text[first], first, last, anchor[new], h[anchor[new]]


def _segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text's index, place in it, bytes) of about ``CHUNK`` bytes; longer texts are cut with ``LENGTH - 1`` bytes shared."""
    held, size = [], 0
    for k, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), CHUNK):
            part = t[a : a + CHUNK + LENGTH - 1]
            if size + len(part) > CHUNK and held:
                yield held
                held, size = [], 0
            held.append((k, a, part))
            size += len(part)
    if held:
        yield held


def _runs(docs: DataFrame) -> DataFrame:
    """dk, dk2, h, sid and the places p, s0, s1 of every run; sid names the slice's bytes and the anchor's place in it."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[list] = [[], [], [], [], [], []]
        for part in _segments(utf8(batch.column("text"))):
            buf = b"".join(x[2] for x in part)
            ends = np.cumsum([len(x[2]) for x in part])
            text, s0, s1, p, h = anchored_runs(buf, ends)
            shift = np.array([e - len(x[2]) - x[1] for e, x in zip(ends.tolist(), part)], np.int64)[text]
            sid = [xxhash.xxh3_64_intdigest(buf[a : b + LENGTH], c - a) for a, b, c in zip(s0.tolist(), s1.tolist(), p.tolist())]
            for o, x in zip(out, (np.array([x[0] for x in part], np.int64)[text], h.view(np.int64), np.array(sid, np.uint64).view(np.int64), p - shift, s0 - shift, s1 - shift)):
                o.append(x)
        cols = [np.concatenate(o) for o in out]
        if not len(cols[0]):
            return None
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(cols[0])) for c in KEY], *[pa.array(c) for c in cols[1:]]], [*KEY, "h", "sid", "p", "s0", "s1"])

    return map_batches(docs.select(*KEY, "text"), work, "dk long, dk2 long, h long, sid long, p long, s0 long, s1 long")


def refine(group: np.ndarray, weight: np.ndarray, slices: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(slices, SPAN) flags: whether the window that starts l bytes before the anchor, for low <= l <= high, occurs twice.

    group: the anchor's number; weight: how often the slice occurs; a slice starts ``high`` bytes before its anchor.
    """
    m = len(slices)
    cells = np.zeros((m, SPAN - 1 + LENGTH), np.uint8)
    sizes = np.fromiter(map(len, slices), np.int64, m)
    row = np.repeat(np.arange(m), sizes)
    column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(SPAN - 1 - high, sizes)
    cells[row, column] = np.frombuffer(b"".join(slices), np.uint8)

    def step(block: np.ndarray, members: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One round: blocks split by the next column; members of blocks that hold one occurrence are settled."""
        _, split = np.unique(block * 256 + symbols, return_inverse=True)
        alive = np.bincount(split, weight[members])[split] >= 2
        return split[alive], members[alive]

    right = np.full((m, SPAN), -1, np.int32)  # right[:, r - GRAM]: block of the r bytes from the anchor on
    block, members = group.astype(np.int64), np.arange(m)
    for c in range(0, GRAM, 8):
        words = np.ascontiguousarray(cells[members, SPAN - 1 + c : SPAN + 7 + c]).view(np.uint64).ravel()
        _, words = np.unique(words, return_inverse=True)
        _, split = np.unique(block * (words.max(initial=0) + 1) + words, return_inverse=True)
        alive = np.bincount(split, weight[members])[split] >= 2
        block, members = split[alive], members[alive]
    right[members, 0] = block
    for r in range(GRAM + 1, LENGTH + 1):
        inside = low[members] <= LENGTH - r  # others have no window that needs so long a prefix
        block, members = step(block[inside], members[inside], cells[members[inside], SPAN - 2 + r])
        right[members, r - GRAM] = block
    found = np.zeros((m, SPAN), bool)
    block, members = group.astype(np.int64), np.arange(m)
    for l in range(SPAN):  # noqa: E741
        if l:
            inside = high[members] >= l
            block, members = step(block[inside], members[inside], cells[members[inside], SPAN - 1 - l])
        own = (low[members] <= l) & (high[members] >= l) & (right[members, LENGTH - l - GRAM] >= 0)
        who = members[own]
        if len(who):
            _, both = np.unique(block[own] * m + right[who, LENGTH - l - GRAM], return_inverse=True)
            found[who, l] = np.bincount(both, weight[who])[both] >= 2
    return found


def _intervals(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to): bytes relative to the anchor that repeated windows cover, a run of windows each."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return row, -(b - 1), -a + LENGTH


def _merged(slices: DataFrame) -> DataFrame:
    """(h, sid, a, b) of the single slices' repeated bytes; every anchor's slices are in one partition."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        h, sid, n, bytes_, low, high = zip(*rows)
        _, group = np.unique(np.array(h, np.int64), return_inverse=True)
        found = refine(group, np.array(n, np.float64), list(bytes_), np.array(low, np.int64), np.array(high, np.int64))
        found[np.array(n) > 1] = False  # those repeat as they are
        row, a, b = _intervals(found)
        return pa.RecordBatch.from_arrays([pa.array(np.array(h, np.int64)[row]), pa.array(np.array(sid, np.int64)[row]), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["h", "sid", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:  # sorted by h, so a group ends where h changes
            for x in zip(*[batch.column(c).to_pylist() for c in ("h", "sid", "n", "bytes", "low", "high")]):
                if x[0] != last and len(held) >= BATCH:
                    yield solve(held)
                    held = []
                if not held or held[-1][:2] != x[:2]:  # rows equal in doc_id and text give the same slices
                    held.append(x)
                last = x[0]
        if held:
            yield solve(held)

    return slices.repartition("h").sortWithinPartitions("h", "sid").mapInArrow(run, "h long, sid long, a long, b long")


def _counted(slices: DataFrame) -> DataFrame:
    """The same for hot anchors: digests of all their windows are counted."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for h, sid, n, x, low, high in zip(*[batch.column(c).to_pylist() for c in ("h", "sid", "n", "bytes", "low", "high")]):
            for l in range(low, high + 1):  # noqa: E741
                d = xxhash.xxh3_128_intdigest(x[high - l : high - l + LENGTH])
                out.append((h, sid, n, l, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["h", "sid", "n", "l", "d1", "d2"])

    rows = map_batches(slices.dropDuplicates(["h", "sid"]), work, "h long, sid long, n long, l long, d1 long, d2 long")
    rows = materialize(rows, "windows")
    again = materialize(rows.groupBy("h", "l", "d1", "d2").agg(F.sum("n").alias("k")).filter("k > 1").drop("k"), "repeated")
    return rows.filter("n = 1").join(again, ["h", "l", "d1", "d2"], "left_semi").select("h", "sid", (-F.col("l")).alias("a"), (LENGTH - F.col("l")).alias("b"))


def repeated_bytes(keyed: DataFrame, hot: int = HOT) -> DataFrame:
    """(dk, dk2, start, stop) of bytes to remove, in intervals that may overlap; ``keyed`` has ``KEY`` and text."""
    runs = materialize(_runs(keyed), "runs")
    twice = materialize(runs.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"), "anchors")
    runs = materialize(runs.join(twice, "h", "left_semi"), "runs")
    place = (*KEY, "p", "s0", "s1")  # of one run, as ``dropDuplicates`` takes it
    names = materialize(runs.groupBy("h", "sid").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in place]), "slices")
    # an anchor whose slices all repeat as they are needs no merge
    mixed = names.groupBy("h").agg(F.min("n").alias("least"), F.count("*").alias("slices")).filter("least = 1 AND slices > 1").select("h", "slices")
    places = names.join(materialize(mixed, "mixed"), "h")
    per_text = materialize(places.groupBy(*KEY).agg(F.collect_list(F.struct("h", "sid", "n", "slices", "p", "s0", "s1")).alias("cuts")), "cuts")  # of one text each

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = dict(zip(zip(*[batch.column(c).to_pylist() for c in KEY]), zip(utf8(batch.column("text")), batch.column("cuts").to_pylist())))  # equal rows once
        out = [
            (c["h"], c["sid"], c["n"], c["slices"], t[c["s0"] : c["s1"] + LENGTH], c["p"] - c["s1"], c["p"] - c["s0"])
            for t, cuts in texts.values()
            for c in cuts
        ]
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["h", "sid", "n", "slices", "bytes", "low", "high"])

    slices = materialize(map_batches(keyed.join(per_text, [*KEY]).select(*KEY, "text", "cuts"), cut, "h long, sid long, n long, slices long, bytes binary, low long, high long"), "slices")
    found = _merged(slices.filter(F.col("slices") <= hot).drop("slices"))
    if not slices.filter(F.col("slices") > hot).isEmpty():
        found = found.unionByName(_counted(slices.filter(F.col("slices") > hot).drop("slices")))
    found = materialize(found, "found")
    single = names.filter("n = 1").select("h", "sid")
    whole = runs.join(single, ["h", "sid"], "left_anti").select(*KEY, F.col("s0").alias("start"), (F.col("s1") + LENGTH).alias("stop"))
    part = runs.join(found, ["h", "sid"]).select(*KEY, (F.col("p") + F.col("a")).alias("start"), (F.col("p") + F.col("b")).alias("stop"))
    return whole.unionByName(part)


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) and kept_sha256 of each row."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk"), F.xxhash64(F.lit(7), "doc_id", "text").alias("dk2"))
    spans = repeated_bytes(keyed.select(*KEY, "text"), hot)
    per_text = materialize(spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")  # of one text each

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t, spans in zip(utf8(batch.column("text")), batch.column("spans").to_pylist()):
            gone = union_of([(s["start"], s["stop"]) for s in spans or ()])
            kept, at = [], 0
            for a, b in gone:
                kept.append(t[at:a])
                at = b
            rest = b"".join([*kept, t[at:]])
            rows.append((len(t), sum(b - a for a, b in gone), len(gone), rest, hashlib.sha256(rest).hexdigest()))
        kinds = [pa.int64()] * 3 + [pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = keyed.join(per_text, [*KEY], "left").select("doc_id", "text", "spans")
    return map_batches(joined, work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
