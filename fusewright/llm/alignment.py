"""Alignment of two tokenizers' tokens, and how often their tokens meet in the corpus.

The tokens of both tokenizers are the nodes of a graph, an edge joins an A and a B token whose byte ranges overlap.
Union-find over it gives the connected components: as both tokenizers cut the same bytes, each is a stretch between two
places where both end a token, and none is cut by such a place, so the components are exactly the minimal groups. A group's members
expand to its links, the overlapping pairs.

Texts are cut before single spaces between other characters, where neither tokenizer joins anything: byte-level words
begin there, and no piece holds a space mark behind another character. A cut piece is encoded, grouped and
expanded once a chunk, however often it occurs; that both ends are token ends and that the tokens' bytes are the text's is tested for every piece.

Counting is distributed. A chunk (about ``SLICE_BYTES`` of texts, or one longer text) is one stored row: its documents' pieces, and
its distinct id pairs with the number of its documents that hold them. Spark sums those by pair, takes each A id's highest sum in
a window (at most B's vocabulary in rows), and sends every chunk the sums of its own pairs, from which its documents' columns follow.
A pair that all documents hold travels once a chunk, so no key holds more rows than there are chunks, and joins of it are split by AQE.

Defined results: null and empty texts, and texts whose joined tokens' bytes are not the text's (with a space before it), have no tokens: zeros and an
empty groups text; very long texts are one chunk, cut in blocks; rows that repeat a doc_id or a text are documents of their own and
count as such; ids of tied counts are all best; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize
from fusewright.llm.common import SLICE_BYTES, ship
from fusewright.llm.near import sorted_set

#: Characters of a text cut at a time, pieces given to a tokenizer as one string, and strings at a time: a tokenizer's own form of a token takes many times its id.
BLOCK, TOGETHER, AT_ONCE = 1 << 20, 256, 32
#: Pieces whose groups are written at a time.
WRITTEN = 1 << 14
#: Bytes of a row group of chunks: readers hold one as a whole.
ROW_GROUP = 8 << 20
MARK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")


class ByteLevel:
    """A byte-level tokenizer of the ``tokenizers`` library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        # the alphabet of byte-level vocabularies: printable bytes as they are, the others from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        vocabulary = self._tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.bytes[k] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A ``sentencepiece`` model that puts a space before each text; texts are given with that space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(k) for k in range(self._model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self._model.is_byte(k) else x.replace(MARK, " ").encode() for k, x in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode([t[1:] for t in texts], num_threads=1)


@lru_cache(maxsize=4)
def load(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


@lru_cache(maxsize=4)
def _token_sizes(path: str) -> np.ndarray:
    return np.array([len(b) for b in load(path).bytes], np.int64)


@lru_cache(maxsize=4)
def _names(path: str) -> list[str]:
    return list(map(str, range(len(load(path).bytes))))


def cut_pieces(text: str) -> Iterator[list[str]]:
    """The text's pieces in order, in lists of about ``BLOCK`` characters; the single spaces between them are left out."""
    at = 0
    while at < len(text):
        end = _CUT.search(text, min(len(text), at + BLOCK))
        stop = end.start() if end else len(text)
        yield _CUT.split(text[at:stop])
        at = end.end() if end else len(text)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed 32-bit ones: chunks travel to their pairs' counts."""
    return pa.compress(np.ascontiguousarray(values, np.int32).tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * n, "zstd", asbytes=True), np.int32)


def _encoded(tokenizer: ByteLevel | Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of each text's)."""
    ids, counts = [np.empty(0, np.int64)], []
    for k in range(0, len(texts), AT_ONCE):
        lists = tokenizer.encode(texts[k : k + AT_ONCE])
        counts += map(len, lists)
        ids.append(np.fromiter(chain.from_iterable(lists), np.int64))
    return np.concatenate(ids), np.array(counts, np.int64)


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


class Distinct:
    """Texts that begin with a space, cut where no tokenizer joins anything, and which of them are encoded alone."""

    def __init__(self, pieces: list[str]):
        self.pieces = [" " + p for p in pieces]
        self.raw = [p.encode() for p in self.pieces]
        self.sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        # what stands beside these in a text might matter
        self.alone = np.fromiter((p[0].isspace() or p[-1].isspace() or MARK in p for p in pieces), bool, len(pieces))

    def encode(self, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, number of each piece's, whether they hold the piece's bytes)."""
        tokenizer, sizes = load(path), _token_sizes(path)
        alone = self.alone
        sure = np.flatnonzero(~alone)
        counts, ids = np.zeros(len(self.pieces), np.int64), [np.empty(0, np.int64)] * 2
        if len(sure):
            pieces, raw = (x if len(sure) == len(x) else [x[k] for k in sure.tolist()] for x in (self.pieces, self.raw))
            flat, _ = _encoded(tokenizer, ["".join(pieces[s : s + TOGETHER]) for s in range(0, len(pieces), TOGETHER)])
            ends, stops = np.cumsum(sizes[flat]), np.cumsum(self.sizes[sure])
            last = np.searchsorted(ends, stops)
            whole = len(ends) and ends[-1] == stops[-1] and (ends[last] == stops).all()
            if whole and b"".join(map(tokenizer.bytes.__getitem__, flat.tolist())) == b"".join(raw):
                counts[sure] = np.diff(np.concatenate(([-1], last)))
                ids[0] = flat
            else:  # some characters have no token of their bytes
                alone = np.ones(len(alone), bool)
        ok = np.ones(len(self.pieces), bool)
        single = np.flatnonzero(alone)
        if not len(single):
            return ids[0], counts, ok
        ids[1], counts[single] = _encoded(tokenizer, [self.pieces[k] for k in single.tolist()])
        stops = np.cumsum(counts[single])
        for k, s, e in zip(single.tolist(), (stops - counts[single]).tolist(), stops.tolist()):
            ok[k] = b"".join(map(tokenizer.bytes.__getitem__, ids[1][s:e].tolist())) == self.raw[k]
        # back in the pieces' order
        owner = np.concatenate((np.repeat(np.flatnonzero(~alone), counts[~alone]), np.repeat(single, counts[single])))
        return np.concatenate(ids)[np.argsort(owner, kind="stable")], counts, ok


class Chunk:
    """Pieces of some texts, aligned. ``add`` texts, then ``align``."""

    def __init__(self, path_a: str, path_b: str):
        self._a, self._b = path_a, path_b
        self._number: dict[str, int] = {}
        self.texts: list[np.ndarray] = []  # numbers of each text's pieces

    def add(self, text: str | None) -> None:
        number = self._number
        parts = [np.fromiter((number.setdefault(p, len(number)) for p in block), np.int32, len(block)) for block in cut_pieces(text or "")]
        self.texts.append(np.concatenate(parts or [np.empty(0, np.int32)]))

    def align(self) -> None:
        pieces = Distinct(list(self._number))
        self._number = {}
        (ids_a, n_a, ok_a), (ids_b, n_b, ok_b) = (pieces.encode(path) for path in (self._a, self._b))
        n = len(pieces.pieces)
        self.ok = ok_a & ok_b
        ids_a, ids_b = ids_a[np.repeat(self.ok, n_a)], ids_b[np.repeat(self.ok, n_b)]
        self.n_a, self.n_b = np.where(self.ok, n_a, 0), np.where(self.ok, n_b, 0)
        # the stretches between neighbouring ends of tokens: one for each overlapping pair
        ends_a, ends_b = np.cumsum(_token_sizes(self._a)[ids_a]), np.cumsum(_token_sizes(self._b)[ids_b])
        ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")  # a merge of two runs
        ends = ends[np.concatenate((ends[1:] != ends[:-1], [True]))] if len(ends) else ends
        a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        root = union_find(len(ids_a) + len(ids_b), a, len(ids_a) + b)  # a component's least node is its first A token
        root_a, root_b = root[: len(ids_a)], root[len(ids_a) :]
        first_a = np.flatnonzero(root_a == np.arange(len(ids_a)))
        first_b = np.searchsorted(root_b, first_a)  # components rise with their tokens
        owner = np.repeat(np.arange(n), self.n_a)
        self.n_groups = np.bincount(owner[first_a], minlength=n)
        self.n_links = np.bincount(owner[a], minlength=n)
        self.pairs, self.links = np.unique(ids_a[a] << 32 | ids_b[b], return_inverse=True)
        names_a, names_b = _names(self._a), _names(self._b)
        starts_a, starts_b = np.append(first_a, len(ids_a)), np.append(first_b, len(ids_b))
        stops = np.concatenate(([0], np.cumsum(self.n_groups)))
        self.groups: list[str] = []
        for k in range(0, n, WRITTEN):
            own = stops[k : k + WRITTEN + 1]
            at_a, at_b = (x[own[0] : own[-1] + 1] for x in (starts_a, starts_b))
            said_a = list(map(names_a.__getitem__, ids_a[at_a[0] : at_a[-1]].tolist()))
            said_b = list(map(names_b.__getitem__, ids_b[at_b[0] : at_b[-1]].tolist()))
            at_a, at_b = (at_a - at_a[0]).tolist(), (at_b - at_b[0]).tolist()
            groups = [f"{','.join(said_a[s:e])}|{','.join(said_b[t:u])}" for s, e, t, u in zip(at_a, at_a[1:], at_b, at_b[1:])]
            own = (own - own[0]).tolist()
            self.groups += [";".join(groups[s:e]) for s, e in zip(own, own[1:])]

    def documents_with(self) -> np.ndarray:
        """How many of the texts hold each pair."""
        n, starts = max(1, len(self.pairs)), np.cumsum(self.n_links) - self.n_links
        who = np.repeat(np.arange(len(self.texts)), [len(t) for t in self.texts])
        who, piece = np.divmod(sorted_set(who * max(1, len(self.n_links)) + np.concatenate([*self.texts, np.empty(0, np.int64)])), max(1, len(self.n_links)))
        size = self.n_links[piece]
        link = np.repeat(starts[piece] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        held = sorted_set(np.repeat(who, size) * n + self.links[link])
        return np.bincount(held % n, minlength=len(self.pairs))


def _columns(kind: str) -> str:
    return f"doc_id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, sizes array<int>"


def _chunks(docs: DataFrame, path_a: str, path_b: str, groups: Callable[[Iterator[str]], str]) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "sizes"]

    def work(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
        chunk = Chunk(path_a, path_b)
        for t in batch.column("text"):
            chunk.add(t.as_py())
        chunk.align()
        chunk.texts = [t if chunk.ok[t].all() else t[:0] for t in chunk.texts]
        rows = [[int(c[t].sum()) for t in chunk.texts] for c in (chunk.n_a, chunk.n_b, chunk.n_groups, chunk.n_links)]
        said = [groups(chunk.groups[k] for k in t.tolist()) if len(t) else "" for t in chunk.texts]
        sizes = np.array([len(t) for t in chunk.texts], np.int32)
        held = chunk.documents_with()
        one = lambda x, t=None: pa.array([x], pa.list_(t) if t is not None else None)
        lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id")), *[one(x, pa.int64()) for x in rows], one(said, pa.string()), one(sizes)]
        blobs = [pa.array([_packed(x)], pa.binary()) for x in (np.concatenate([*chunk.texts, np.empty(0, np.int32)]), chunk.n_links, chunk.links)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([len(chunk.n_links)], pa.int32()), *blobs, one(chunk.pairs), one(held)], ["chunk", *names, "n_pieces", "pieces", "piece_links", "links", "pairs", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # stored with the task's rows, so one attempt's numbers count
        for batch in batches:
            rows = max(1, int(SLICE_BYTES * batch.num_rows / max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, rows):
                yield work(batch.slice(first, rows), number)
                number += 1

    ship(docs.sparkSession)
    schema = f"chunk long, {_columns(kind)}, n_pieces int, pieces binary, piece_links binary, links binary, pairs array<long>, held array<long>"
    # rows are megabytes long, so the writer's buffers are looked at row by row; a reader decodes all rows of a group at once
    checks = {f"parquet.{x}.size.row.check.{end}": n for x, ends in (("page", "14"), ("block", "11")) for end, n in zip(("min", "max"), ends)}
    options = {**checks, "parquet.block.size": str(ROW_GROUP), "compression": "zstd"}
    return materialize(docs.select("doc_id", "text").mapInArrow(run, schema), "aligned", **options)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold the ids linked (A << 32 | B), and whether no other pair of the A id has more."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a"))).drop("a")


def align_documents(docs: DataFrame, path_a: str, path_b: str, groups: Callable[[Iterator[str]], str] = ";".join) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the A id's most frequent), count_sum (of the links' counts) and groups of each row.

    A group is its A ids and its B ids, ``a1,a2|b1``; ``groups`` makes a document's column of its pieces' groups, in order.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = _chunks(docs, path_a, path_b, groups)
    counts = materialize(pair_counts(chunks), "counts")
    asked = chunks.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "best")).alias("answers"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                found = row.column("answers").flatten()
                at = found.field("at").to_numpy()
                n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                n[at], best[at] = found.field("n").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(row.column("sizes").flatten().to_numpy(), dtype=np.int64)))
                blob = lambda c, m: _unpacked(row.column(c)[0].as_py(), m)  # noqa: B023, E731
                pieces, stops = blob("pieces", int(ends[-1])), np.cumsum(blob("piece_links", row.column("n_pieces")[0].as_py()), dtype=np.int64)
                links = blob("links", int(stops[-1]) if len(stops) else 0)
                sums = [np.diff(np.concatenate(([0], np.cumsum(x[links])))[np.concatenate(([0], stops))]) for x in (n, best)]  # of each piece
                n_sum, n_best = (np.diff(np.concatenate(([0], np.cumsum(s[pieces])))[ends]) for s in sums)
                yield pa.RecordBatch.from_arrays([*[row.column(c).flatten() for c in columns], pa.array(n_best), pa.array(n_sum)], [*columns, "n_best", "count_sum"])

    joined = chunks.drop("pairs", "held").join(answers.hint("shuffle_hash"), "chunk", "left")
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    return joined.select(*columns, "sizes", "n_pieces", "pieces", "piece_links", "links", F.coalesce("answers", F.array()).alias("answers")).mapInArrow(run, out)
