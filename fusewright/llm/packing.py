"""Best-fit packing of token sequences by a configuration linear program.

1. Texts are tokenised and cut into pieces of at most ``capacity`` tokens.
2. The driver reads the length histogram (at most ``capacity`` rows, whatever the input).
3. Lengths are grouped into classes, to the nearest ``capacity / UNITS`` tokens. The configuration program
   (fewest sequences so that every class is covered, one variable per way to fill a
   sequence) is solved by multiplicative weights: each class has a price, a knapsack
   dynamic program finds the filling of highest price, its variable grows by ``STEP`` of its scarcest
   class, and the prices of what it covers fall by exp(-``SHARPNESS`` * share covered); a class covered in full has no price, so none is over-covered. Any
   prices, scaled so that no filling is worth more than one, are a solution of the dual program, which gives a lower bound.
4. The variables are rounded down. Their slots
   take real pieces, longest first, while there is room; what remains is put by best fit into the room that is left,
   longest first, then into new sequences. Best fit alone is planned too, and the plan with fewer sequences taken.
5. The plan names runs of equal fillings, so its size follows the number of distinct
   lengths, not of documents. Pieces find their place by their rank among the pieces of equal length.

Ranks are counted in salted parts of each length, by rows' own numbers, and of parts there are more as the pieces are, so one length or one repeated row that holds a
third of all pieces is no hot task; and a part meets only the plan's intervals of its own ranks.

Defined results: a null or empty text is one piece of the end token alone; a null doc_id is kept; rows that
repeat a doc_id are packed as rows of their own; very long texts are cut into as many pieces as they need; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize
from fusewright.llm.common import ByteCache, map_batches, ship, utf8

UNITS = 256
STEP, SHARPNESS = 0.05, 5.0
#: Parts in which the ranks of a length are counted: so many at least, and one for so many pieces.
SALTS, PART_PIECES = 64, 1 << 22
#: Bytes of a worker's caches of words and of their parts, and of the longest word in them: text without spaces is one word, and seen once.
CACHED_WORDS, CACHED_PARTS, CACHED_WORD = 64 << 20, 96 << 20, 64
#: The plan is broadcast up to so many intervals, and joined by a shuffle beyond.
BROADCAST_INTERVALS = 200_000

_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*)")
#: Byte-level vocabularies write the bytes 0x80 to 0xa0 and 0xad of UTF-8 as characters from U+0122 on, in turn, and others as themselves.
_SHIFTED = {b: chr(0x122 + k) for k, b in enumerate([*range(0x80, 0xA1), 0xAD])}
_ALPHABET = {c: "".join(_SHIFTED.get(b, chr(b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class _Parts(ByteCache):
    """Ids by lower-case letters or by punctuation, straight from the tokenizer's model, whose alphabet stands for UTF-8 bytes."""

    def __init__(self, tokenizer):
        super().__init__(CACHED_PARTS)
        self[""] = b""
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, part: str) -> bytes:
        ids = [t.id for t in self.tokenize(part if part.isascii() else part.translate(_ALPHABET))]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= CACHED_WORD:
            self.keep(part, packed, len(packed))
        return packed


class WordCache(ByteCache):
    """Token ids, as little-endian unsigned 32-bit integers, by word between ASCII spaces.

    The vocabulary drops white space before it splits, so no token crosses a space and a text's ids
    are its words' ids in turn. It also lower-cases and splits letters from punctuation, so a plain word with
    punctuation at its end has the ids of its lower-case letters, then those of its end. The words and parts seen first, which the frequent
    ones are among, are kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(CACHED_WORDS)
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _Parts(self.tokenizer)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        plain = _PLAIN.fullmatch(text)
        if plain:
            packed = self.parts[plain[1].lower()] + self.parts[plain[2]]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHED_WORD:
            self.keep(word, packed, len(packed))
        return packed

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """The worker process's cache; as a function of this module it outlives the task, which a captured object would not."""
    return WordCache(path)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = word_cache(tokenizer)
        rows: list[tuple[int, int, int, int, int]] = []
        texts = utf8(batch.column("text"))
        for at, text in enumerate(texts):
            ids = cache.encode(text) + end
            rows += [(at, k, k * capacity, len(part := ids[k * width : (k + 1) * width]) // 4, zlib.crc32(part)) for k in range(-(-len(ids) // width))]
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return map_batches(docs.select("doc_id", "text"), cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def dearest_filling(prices: np.ndarray) -> np.ndarray:
    """Knapsack by dynamic programming: how often each class (of 1, 2, ... units) is in the filling of highest price."""
    units = len(prices)
    best, choice = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for c in range(1, units + 1):
        value = best[c - 1 :: -1][:c] + prices[:c]
        k = int(np.argmax(value))
        best[c], choice[c] = (value[k], k + 1) if value[k] > best[c - 1] else (best[c - 1], 0)
    counts, c = np.zeros(units, np.int64), units
    while c > 0:
        if choice[c]:
            counts[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return counts


@dataclass
class Program:
    """Fillings and how often to use each (a real number), their sum, and a lower bound of the optimum of the classes, which is not one of the pieces."""

    fillings: list[tuple[np.ndarray, float]]
    objective: float
    bound: float


def solve_configurations(demand: np.ndarray) -> Program:
    """The configuration program of the classes' demands; stops when less than one sequence is uncovered. Prices start at the classes' sizes over capacity."""
    demand = demand.astype(float)
    units, on = len(demand), demand > 0
    size = np.arange(1, units + 1) / units
    covered, average = np.zeros(units), np.zeros(units)
    used: dict[bytes, float] = defaultdict(float)
    bound = float(demand @ size)
    while True:
        share = np.divide(covered, demand, out=np.ones(units), where=on)
        open_ = share < 1 - 1e-9
        if not open_.any() or (size * (demand - covered))[open_].sum() < 1:
            break
        prices = np.where(open_, size * np.exp(-SHARPNESS * share), 0.0)
        filling = dearest_filling(prices)
        bound = max(bound, float(demand @ prices / (filling @ prices)))
        inside = filling > 0
        room = ((demand - covered)[inside] / filling[inside]).min()
        grow = max(min(room, STEP * (demand[inside] / filling[inside]).min()), min(room, 1.0))
        used[filling.tobytes()] += grow
        covered += grow * filling
        average += grow * np.where(on, size * np.exp(-SHARPNESS * share), 0.0) / (filling @ prices)
    objective = sum(used.values())
    if objective:
        bound = max(bound, float(demand @ average / (dearest_filling(average) @ average)))
    return Program([(np.frombuffer(k, np.int64), v) for k, v in used.items()], objective, bound)


@dataclass
class Run:
    """``times`` sequences that hold the same lengths in the same order."""

    lengths: tuple[int, ...]
    times: int


def plan_runs(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs of sequences that hold every piece of the histogram once: by the program or by best fit alone, whichever takes fewer."""
    unit = max(1, capacity // UNITS)
    demand = np.zeros(_class(capacity, unit), np.int64)
    for n, k in histogram.items():
        demand[_class(n, unit) - 1] += k
    program = solve_configurations(demand)
    plans = [fill(histogram, capacity, [(f, int(v + 1e-9)) for f, v in program.fillings if v + 1e-9 >= 1]), fill(histogram, capacity, [])]
    return min(plans, key=lambda runs: sum(r.times for r in runs))


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by tokens, and by the program of classes rounded down, whose fillings hold all that real pieces can fill a sequence with."""
    unit = max(1, capacity // UNITS)
    demand = np.zeros(capacity // unit, np.int64)
    for n, k in histogram.items():
        if n >= unit:
            demand[n // unit - 1] += k
    tokens = -(-sum(n * k for n, k in histogram.items()) // capacity)
    return max(tokens, math.ceil(solve_configurations(demand).bound - 1e-6) if demand.any() else 0)


def _class(n: int, unit: int) -> int:
    return max(1, (n + unit // 2) // unit)


def fill(histogram: dict[int, int], capacity: int, fillings: list[tuple[np.ndarray, int]]) -> list[Run]:
    """Runs of sequences from fillings of classes, then best fit."""
    left = {n: k for n, k in histogram.items() if k}
    unit = max(1, capacity // UNITS)
    top = lambda c: c * unit + unit - unit // 2 - 1
    stock = sorted(left)  # lengths of which some are left
    runs: list[Run] = []
    for filling, times in fillings:
        slots = [c + 1 for c in np.flatnonzero(filling)[::-1] for _ in range(filling[c])]
        while times:
            takes: dict[int, int] = defaultdict(int)
            room, chosen = capacity, []
            for c in slots:
                # the class's longest piece; the last slot takes the longest that fits into what the classes' rounding left
                at = bisect_right(stock, room if c is slots[-1] and len(chosen) == len(slots) - 1 else min(room, top(c))) - 1
                while at >= 0 and left[stock[at]] <= takes[stock[at]]:
                    at -= 1
                if at >= 0:
                    takes[stock[at]] += 1
                    room -= stock[at]
                    chosen.append(stock[at])
            takes = {n: t for n, t in takes.items() if t}
            if not takes:
                break
            k = min(times, *(left[n] // t for n, t in takes.items()))
            for n, t in takes.items():
                left[n] -= k * t
                if not left[n]:
                    stock.pop(bisect_left(stock, n))
            runs.append(Run(tuple(chosen), k))
            times -= k
    # best fit, longest first, on runs with equal room
    rooms: dict[int, list[Run]] = defaultdict(list)
    for r in runs:
        rooms[capacity - sum(r.lengths)].append(r)
    open_rooms = sorted(k for k, v in rooms.items() if v)

    def put(room: int, run: Run) -> None:
        if not rooms[room]:
            insort(open_rooms, room)
        rooms[room].append(run)

    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(open_rooms, n)
            if at < len(open_rooms):
                room = open_rooms[at]
                run = rooms[room].pop()
                if not rooms[room]:
                    open_rooms.pop(at)
                each = min(room // n, max(1, todo // run.times))
                k = min(run.times, todo // each) or 1
                if k < run.times:
                    put(room, Run(run.lengths, run.times - k))
            else:
                room, run = capacity, Run((), 0)
                each = min(capacity // n, todo)
                k = todo // each
            todo -= k * each
            put(room - n * each, Run(run.lengths + (n,) * each, k))
    return [r for room in sorted(rooms) for r in rooms[room] if r.times]


def intervals(runs: list[Run]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, first_sequence, per_sequence, offset): the places of the pieces of a length by rank."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for r in runs:
        offset = 0
        for n in sorted(set(r.lengths), reverse=True):
            per = r.lengths.count(n)
            rows.append((n, rank[n], rank[n] + per * r.times, sequence, per, offset))
            rank[n] += per * r.times
            offset += per * n
        sequence += r.times
    return rows


def pack_pieces(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces; ``cut`` is a stored table, read three times, with length and row, a number of each row's own."""
    spark = cut.sparkSession
    salts = max(SALTS, -(-cut.count() // PART_PIECES))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    counts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows = intervals(plan_runs(histogram, capacity))
    schema = "length long, rank_from long, rank_to long, first_sequence long, per_sequence long, at long"
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n")
    own = (F.col("rank_from") < F.col("before") + F.col("n")) & (F.col("rank_to") > F.col("before"))
    plan = materialize(starts.join(spark.createDataFrame(rows, schema), "length").filter(own).drop("n"), "plan")
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    ranked = salted.withColumn("inside", inside)
    if plan.count() <= BROADCAST_INTERVALS:
        plan = F.broadcast(plan)
    rank = F.col("before") + F.col("inside")
    placed = ranked.join(plan, ["length", "salt"]).filter((rank >= F.col("rank_from")) & (rank < F.col("rank_to")))
    past = rank - F.col("rank_from")
    sequence = F.col("first_sequence") + F.floor(past / F.col("per_sequence"))
    offset = F.col("at") + F.pmod(past, F.col("per_sequence")) * F.col("length")
    return placed.select(*[c for c in cut.columns if c != "row"], sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    ship(docs.sparkSession)
    return pack_pieces(materialize(pieces(docs, tokenizer, end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity)
