"""Runs of repeated words, by branching tandem repeats of a suffix tree.

A run is a stretch of words with smallest period q, of at least ``max(MIN_LENGTH, 2 q)`` words, that
no neighbouring word extends keeping that period. At the right end of every run stands a tandem repeat (the same q words
twice) that the next word does not continue: a branching one. Its two halves are leaves that part in the
suffix tree at a node of depth q. So:

1. Words that no repeated ``GRAM`` covers cannot be in a run (a run repeats at least ``GRAM`` words at the distance of
   its period, and those cover it). The others form segments, and a run lies in one segment.
2. The suffix tree of a batch's segments is taken from their suffix order, by prefix doubling of what is not settled
   yet, and the lengths of common prefixes. Nodes of several children are split in two, again and again.
3. Every node's leaf list is walked in its smaller half only: a leaf i of it whose partner, i + depth or i - depth, is a leaf
   of the other half starts (or is the middle of) a branching tandem repeat. This is n log n leaves in all.
4. A repeat is rotated to the left as long as the words agree, which gives its run. Repeats that end together, the period of
   one of which is a multiple of the other's, are the same run, named by the least.

All work is inside the row's task and grows with its text; nothing is shuffled, so no key is hot. A batch holds about ``SLICE_BYTES`` of texts
or one longer text, which is treated whole.

Defined results: a null or empty text has no words, no runs and an empty text; very long texts are read whole;
rows that repeat a doc_id or a text each get their own result; ties have one order (runs by start, then period); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.llm.common import let, map_batches, utf8
from fusewright.llm.near import mix

MIN_LENGTH = 12
#: A run of L words with period q repeats L - q >= MIN_LENGTH / 2 words.
GRAM = MIN_LENGTH // 2
#: Leaves walked at a time.
LEAVES = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def _repeated_cover(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions covered by ``GRAM`` words that occur twice in their text; ``doc`` rises. Hashes that meet only cover more."""
    n = len(ids) - GRAM + 1
    cover = np.zeros(len(ids), bool)
    if n < 2:
        return cover
    word = mix(ids.astype(np.uint64) + np.uint64(1))
    h = word[:n].copy()
    for k in range(1, GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    inside = doc[:n] == doc[GRAM - 1 :]
    at = np.flatnonzero(inside)
    h = mix(h[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(0x51ED27)))
    # most are alone in their slot of a table of counts, and need no sorting
    slot = (h >> np.uint64(64 - min(30, len(h).bit_length() + 2))).astype(np.int64)
    shared = np.bincount(slot)[slot] > 1
    h, at = h[shared], at[shared]
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return cover
    place = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    at = at[twice[place] == h]
    step = np.zeros(len(ids) + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + GRAM, -1)
    return np.cumsum(step[:-1]) > 0


def suffix_order(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all segments in order, and each one's place in it. A suffix ends with its segment; segments share no word."""
    n = len(words)
    _, rank = np.unique(words, return_inverse=True)
    counts = np.bincount(rank)
    rank = (np.cumsum(counts) - counts)[rank]  # the place of the first of equals
    alive = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    last = np.append(np.flatnonzero(segment[1:] != segment[:-1]), n - 1)
    end = (last + 1)[np.searchsorted(last, np.arange(n))]  # of the segment
    step = 1
    while len(alive):
        there = alive + step
        after = np.where(there < end[alive], rank[np.minimum(there, n - 1)] + 1, 0)
        order = np.lexsort((after, rank[alive]))
        alive, after = alive[order], after[order]
        group = rank[alive]
        at = np.arange(len(alive))
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        new = new_group | np.concatenate(([True], after[1:] != after[:-1]))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[alive] = group + start - np.maximum.accumulate(np.where(new_group, at, 0))
        alone = new & np.append(new[1:], True)
        alive = alive[~alone]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, rank


def common_prefixes(words: np.ndarray, segment: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """[k]: the length of the common prefix of the suffixes at places k - 1 and k, within their segments; place 0 has none."""
    # a separator of its own after every segment, so that comparisons end there
    apart = np.concatenate(([0], np.cumsum(segment[1:] != segment[:-1])))
    text = np.full(len(words) + int(apart[-1]) + 1, -1, np.int64)
    at = np.arange(len(words)) + apart
    text[at] = words
    gaps = np.flatnonzero(text < 0)
    text[gaps] = -1 - np.arange(len(gaps))
    s, place, before = text.tolist(), at.tolist(), order.tolist()
    out = [0] * len(words)
    h = 0
    fresh = (segment[1:] != segment[:-1]).tolist()
    for i, k in enumerate(rank.tolist()):
        if i and fresh[i - 1]:
            h = 0
        if k:
            a, b = place[i] + h, place[before[k - 1]] + h
            while s[a] == s[b]:
                a += 1
                b += 1
                h += 1
            out[k] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def binary_nodes(prefix: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, left, middle, right) of the tree's inner nodes below the root, split in two: leaf lists are places [left, middle) and [middle, right)."""
    n = len(prefix)
    left, right = [0] * n, [n] * n
    stack: list[int] = []
    for k in range(1, n):
        d = prefix[k]
        while stack and prefix[stack[-1]] > d:
            right[stack.pop()] = k
        left[k] = stack[-1] if stack else 0
        stack.append(k)
    depth = np.array(prefix, np.int64)
    at = np.flatnonzero(depth > 0)
    return depth[at], np.array(left, np.int64)[at], at, np.array(right, np.int64)[at]


def branching_repeats(order: np.ndarray, rank: np.ndarray, prefix: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat, from the leaf lists' smaller halves."""
    depth, left, middle, right = binary_nodes(prefix)
    n = len(order)
    low_side = middle - left <= right - middle
    first, size = np.where(low_side, left, middle), np.where(low_side, middle - left, right - middle)
    other, other_end = np.where(low_side, middle, left), np.where(low_side, right, middle)
    cuts = np.searchsorted(np.cumsum(size), np.arange(LEAVES, int(size.sum()) + LEAVES, LEAVES)) + 1
    starts, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    begin = 0
    for stop in np.minimum(cuts, len(size)).tolist():
        if stop <= begin:
            continue
        part = slice(begin, stop)
        begin = stop
        node = np.repeat(np.arange(part.start, part.stop), size[part])
        within = np.arange(len(node)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        leaf, d = order[first[node] + within], depth[node]
        for partner, start in ((leaf + d, leaf), (leaf - d, leaf - d)):
            ok = (partner >= 0) & (partner < n)
            place = rank[np.where(ok, partner, 0)]
            ok &= (place >= other[node]) & (place < other_end[node])
            starts.append(start[ok])
            periods.append(d[ok])
    return np.concatenate(starts), np.concatenate(periods)


def _rotated(words: np.ndarray, low: int, start: int, period: int) -> int:
    """Where the run begins whose right end's repeat begins at ``start``: not before ``low``."""
    block = 64
    while start > low:
        a = max(low, start - block)
        apart = np.flatnonzero(words[a:start] != words[a + period : start + period])
        if len(apart):
            return a + int(apart[-1]) + 1
        start, block = a, 2 * block
    return start


def segment_runs(words: np.ndarray, segment: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs; ``segment`` rises."""
    words = segment * (words.max() + 1) + words  # no word of one segment is equal to one of another
    order, rank = suffix_order(words, segment)
    start, period = branching_repeats(order, rank, common_prefixes(words, segment, order, rank))
    end = start + 2 * period
    first = np.searchsorted(segment, segment[start])  # of the segment
    # short periods need MIN_LENGTH words with that period before the end
    ok = end - first >= MIN_LENGTH
    for k in range(MIN_LENGTH):
        here = ok & (k >= period)
        ok[here] = words[end[here] - 1 - k] == words[end[here] - 1 - k + period[here]]
    keep = np.lexsort((period[ok], end[ok]))
    runs: list[tuple[int, int, int]] = []
    known: list[tuple[int, int]] = []  # (start, period) of the runs that end at ``at``
    at = -1
    for s, p, e, low in zip(*(x[ok][keep].tolist() for x in (start, period, end, first))):
        if e != at:
            at, known = e, []
        if any(p % q == 0 and begin <= s for begin, q in known):
            continue
        begin = _rotated(words, low, s, p)
        known.append((begin, p))
        runs.append((begin, e - begin, p))
    return runs


def text_runs(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, (start, length, period)) of the runs of texts of ``sizes`` words, in order of text, start and period."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(_repeated_cover(ids, doc))
    none = np.empty(0, np.int64), np.empty((0, 3), np.int64)
    if not len(at):
        return none
    fresh = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])))
    segment = np.cumsum(fresh) - 1
    long_enough = np.bincount(segment)[segment] >= MIN_LENGTH
    at, segment = at[long_enough], segment[long_enough]
    if not len(at):
        return none
    found = np.array(segment_runs(ids[at], segment), np.int64).reshape(-1, 3)
    place = at[found[:, 0]]
    text = doc[place]
    found[:, 0] = place - (np.cumsum(sizes) - sizes)[text]
    order = np.lexsort((found[:, 2], found[:, 0], text))
    return text[order], found[order]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the text without repetitions, words joined by one space) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [t.split() for t in utf8(batch.column("text"))]  # at 0x20 and 0x09 to 0x0D
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
        sizes = np.array([len(ws) for ws in words], np.int64)
        del number
        text, runs = text_runs(ids, sizes)
        cuts = np.searchsorted(text, np.arange(len(words) + 1))
        kept = [collapsed(ws, runs[a:b]) for ws, a, b in zip(words, cuts.tolist(), cuts[1:].tolist())]
        parts = pa.StructArray.from_arrays([pa.array(c) for c in runs.T.copy()], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, with its tail made periodic if doc_id's checksum ends in 0: a fixed rule, so that every corpus has runs."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        return let(F.struct(words.alias("w"), a.alias("a"), p.alias("p")), lambda x: F.concat_ws(" ", F.slice(x["w"], F.lit(1), x["a"].cast("int")), F.transform(
            F.sequence(x["a"], F.size(x["w"]).cast("long") - 1), lambda i: F.get(x["w"], (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")))))

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words, tail)).otherwise(text)
