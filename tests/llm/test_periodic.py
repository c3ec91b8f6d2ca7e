"""Runs of repeated words against brute force, on the operator and on the registered query."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from fusewright.llm.periodic import periodic_runs, text_runs

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    """Every maximal stretch of every period, the least period of each."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def repetitive(rng):
    n, letters = rng.choice([0, 5, 11, 12, 13, 40, 90]), rng.choice([1, 2, 3, 6, 30])
    words = [str(rng.randrange(letters)) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        at, period = rng.randrange(n + 1), rng.randrange(1, 9)
        block = [str(rng.randrange(letters)) for _ in range(period)]
        words[at:at] = [block[k % period] for k in range(rng.randrange(30))]
    return words


def test_runs_of_random_texts():
    rng = random.Random(3)
    found = 0
    for _ in range(400):
        texts = [repetitive(rng) for _ in range(rng.randrange(1, 6))]
        text, runs = text_runs(np.array([int(w) for ws in texts for w in ws], np.int64), np.array([len(ws) for ws in texts], np.int64))
        expected = [brute_runs(ws) for ws in texts]
        assert [sorted(map(tuple, runs[text == k].tolist())) for k in range(len(texts))] == expected
        found += sum(map(len, expected))
    assert found > 500


@pytest.mark.parametrize("period", [1, 7, 50_021])
def test_one_long_run(period):
    text, runs = text_runs(np.arange(300_000) % period, np.array([300_000]))
    assert text.tolist() == [0] and runs.tolist() == [[0, 300_000, period]]


def test_runs_of_documents(spark, docs):
    rng = random.Random(5)
    texts = [rng.choice([" ", "\n", "\t \x0b"]).join(repetitive(rng)) for _ in range(120)]
    texts += [None, "", " \n", "a b " * 3, "a b " * 6, "a b " * 12, "ä " * 11, "ä " * 12, "x " * 30_000, *texts[:9]]
    rows = [(k % 100 if k % 7 else None, t, "en", "s") for k, t in enumerate(texts)]
    df = docs(*rows).withColumnsRenamed({"lang": "runs", "source": "collapsed"})  # clashing names
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(df).collect())
    expected = []
    for key, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [(0, 30_000, 1)] if len(words) == 30_000 else brute_runs(words)
        expected.append((key is not None, key or 0, len(words), runs, brute_collapsed(words, runs)))
    assert got == sorted(expected)
    assert periodic_runs(docs()).collect() == []


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_runs_query(spark):
    queries = pytest.importorskip("fusewright.llm.queries")
    got = {r["doc_id"]: r.asDict() for r in queries.op13_periodic_runs(spark, SF).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for key, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words) if n < 2000 else _by_grams(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        expected = {
            "doc_id": key, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": best[1] * 1000 // best[2] if runs else None,
            "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), "collapsed_sha256": sha(brute_collapsed(words, runs)),
        }
        assert got.pop(key) == expected, key
    assert not got


def _by_grams(words):
    """The same for long texts: only periods at which six words repeat."""
    places, periods = {}, set()
    for k in range(len(words) - 5):
        places.setdefault(tuple(words[k : k + 6]), []).append(k)
    for at in places.values():
        periods |= {b - a for k, a in enumerate(at) for b in at[k + 1 :]}
    n, out = len(words), {}
    for q in sorted(periods):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in out.items())
