"""Token alignment against whole texts encoded by both tokenizers."""

import hashlib
import random
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest

from fusewright.llm import alignment
from fusewright.llm.alignment import align_documents, load

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute_text(text):
    """(A ids, B ids, groups, links) of a whole text."""
    if not text:
        return [], [], "", []
    a, b = load(A).encode([" " + text])[0], load(B).encode([" " + text])[0]
    bytes_a, bytes_b = [load(A).bytes[k] for k in a], [load(B).bytes[k] for k in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], "", []
    span_a, span_b = ends(bytes_a), ends(bytes_b)
    links, j = [], 0
    for (s, e), x in zip(span_a, a):
        while span_b[j][1] <= s:
            j += 1
        k = j
        while k < len(b) and span_b[k][0] < e:
            links.append((x, b[k]))
            k += 1
    stops = sorted({e for _, e in span_a} & {e for _, e in span_b})
    groups, i, j = [], 0, 0
    for stop in stops:
        left, right = [], []
        while i < len(a) and span_a[i][1] <= stop:
            left.append(str(a[i]))
            i += 1
        while j < len(b) and span_b[j][1] <= stop:
            right.append(str(b[j]))
            j += 1
        groups.append(",".join(left) + "|" + ",".join(right))
    return a, b, ";".join(groups), links


def brute(rows):
    texts = [brute_text(t) for _, t in rows]
    count, best = defaultdict(int), defaultdict(int)
    for *_, links in texts:
        for pair in set(links):
            count[pair] += 1
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted(
        (key is not None, key or 0, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), groups)
        for (key, _), (a, b, groups, links) in zip(rows, texts)
    )


def rows_of(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in df.collect())


ODD = [
    None, "", " ", "\n", "  ", "a", " a", "a ", "a  b", "a \n b", "\tx y\r\nz", "▁", "a ▁b", "x▁ y", "<|endoftext|> <s> </s><unk>", "<0x41> b", "ﬁne ①é́ 😀 日本語 ok", "it's we'll o'clock 12'34",
    "\x00 \x1c a\x1cb \x85 c", "a b 　c", "é ́ a", "é " * 40, "A-b_c;d  12,5% $x", "x" * 900, "word " * 30_000, "\U0010ffff a", "a​b   c", "1 2 3 4",
]


@pytest.mark.parametrize("block", [1, 7, 50])
def test_pieces_of_blocks(monkeypatch, block):
    whole = {t: [p for part in alignment.cut_pieces(t) for p in part] for t in ODD if t}
    monkeypatch.setattr(alignment, "BLOCK", block)
    for t, pieces in whole.items():
        assert [p for part in alignment.cut_pieces(t) for p in part] == pieces and " ".join(pieces) == t


def test_alignment(spark, docs):
    rng = random.Random(2)
    words = ["the", "quick", "naïve", "don't", "(x)", "12", "3.5", "Straße", "\n", "", "été", "--", "end.\nNext", "\t", " ", "ok "]
    texts = [*ODD, *[" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(150)]]
    texts += texts[-20:]
    rows = [(k % 130 if k % 9 else None, t) for k, t in enumerate(texts)]
    df = docs(*[(k, t, "en", "s") for k, t in rows]).withColumnsRenamed({"lang": "pair", "source": "chunk", "n_chars": "n_a"})  # clashing names
    assert rows_of(align_documents(df.repartition(3), A, B)) == brute(rows)


def test_chunks_do_not_matter(spark, docs):
    rows = [(k, t) for k, t in enumerate(ODD * 3) if not t or len(t) < 1000]
    df = docs(*[(k, t, "en", "s") for k, t in rows])
    assert rows_of(align_documents(df.repartition(17), A, B)) == rows_of(align_documents(df.coalesce(1), A, B)) == brute(rows)
    assert align_documents(docs(), A, B).collect() == []


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_alignment_query(spark):
    queries = pytest.importorskip("fusewright.llm.queries")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_token_alignment(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    expected = [(*r[1:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows)]
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_chunks_are_held_in_small_parts(spark, docs, monkeypatch):
    """Row groups of few chunks, as readers decode a whole one, compressed numbers, and few strings at a time for a tokenizer."""
    import pyarrow.parquet as pq

    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=150_000)) for _ in range(12)]
    monkeypatch.setattr(alignment, "ROW_GROUP", 1 << 18, raising=False)
    chunks = alignment._chunks(docs(*texts).coalesce(1), A, B, ";".join)
    files = [pq.ParquetFile(str(p)) for p in Path(chunks._stored_at.removeprefix("file:")).glob("*.parquet")]
    rows = [f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert sum(rows) == chunks.count() > 2 and max(rows) == 1
    assert sum(len(r["pieces"]) for r in chunks.select("pieces").collect()) < 0.8 * 4 * 150_000 * len(texts)

    given, encode = [], alignment.ByteLevel.encode
    monkeypatch.setattr(alignment.ByteLevel, "encode", lambda self, texts: given.append(len(texts)) or encode(self, texts))
    pieces = alignment.Distinct([f"{x}{y}" for x in words[:200] for y in words[:100]])
    ids, counts, ok = pieces.encode(A)
    assert max(given) <= 32 and ok.all() and len(counts) == 20_000 and counts.sum() == len(ids)
