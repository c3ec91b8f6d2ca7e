"""Line dedup, SimHash, similarity classes, repeated substrings: all against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fusewright.llm import line_dedup as ld
from fusewright.llm import near, repeats, simhash

SYLLABLES = "ka lo mi re tu va ne so pi du xo ze fa gu hy".split()


def sentence(rng, n=14):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def edited(rng, text, edits=1):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "".join(rng.choice(SYLLABLES) for _ in range(2))
    return " ".join(words)


def classes(keys, linked):
    """The least member of each key's component."""
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    lines = [sentence(rng) for _ in range(40)]
    texts = []
    for _ in range(n):
        part = [rng.choice(lines) for _ in range(rng.randrange(1, 6))]
        texts.append("\n".join(edited(rng, x, rng.randrange(3)) if rng.random() < 0.4 else x for x in part))
    base = sentence(rng, 60)
    return [*texts, *[edited(rng, base, 1) for _ in range(90)], None, "", "\n \n", "a", "A", "b", texts[0], "z" * 20_000]


def brute_lines(rows):
    seen, first, sets = {}, {}, {}
    for key, text in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate(text.split("\n")):
            if line.encode().split():
                sets.setdefault(line, ld.shingles(line))
                seen.setdefault(line, []).append((key, k))
    names = list(sets)
    alike = [(a, b) for i, a in enumerate(names) for b in names[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = classes(names, alike)
    order = lambda o: (o[0] is not None, o[0] or 0, o[1])
    for line in names:
        for o in seen[line]:
            first[root[line]] = min(first.get(root[line], o), o, key=order)
    gone = {}
    for line in names:
        for o in seen[line]:
            if o != first[root[line]]:
                gone.setdefault(o[0], set()).add(o[1])
    return gone


def test_line_dedup(spark, docs):
    rows = [(k, t, "en", "s") for k, t in enumerate(corpus())]
    rows.append((None, rows[0][1], None, None))
    gone = brute_lines([(r[0], r[1]) for r in rows])
    out = ld.dedup_lines(docs(*rows).withColumn("removed", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    assert {r["row"]["doc_id"]: set(r["removed"]) for r in out if r["removed"]} == gone
    for r in out:
        old = texts[r["row"]["doc_id"]]
        assert r["row"]["removed"] == "clash"
        assert r["row"]["text"] == (None if old is None else "\n".join(x for k, x in enumerate(old.split("\n")) if k not in gone.get(r["row"]["doc_id"], ())))
    assert ld.dedup_documents(docs(*rows).limit(0)).count() == 0


def test_chunked_groups_give_the_same(spark, docs, monkeypatch):
    rows = [(k, t, "en", "s") for k, t in enumerate(corpus(4, 30))]
    monkeypatch.setattr(near, "CHUNK", 8)
    monkeypatch.setattr(near, "SMALL", 3)
    monkeypatch.setattr(near, "PER_MEMBER", 1)
    out = ld.dedup_lines(docs(*rows)).collect()
    assert {r["row"]["doc_id"]: set(r["removed"]) for r in out if r["removed"]} == brute_lines([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("key", [None, 7])
def test_lines_of_rows_that_share_an_id(spark, docs, key):
    rng = random.Random(14)
    a, b, c, d, same = (sentence(rng) for _ in range(5))
    rows = [(key, f"{a}\n{same}"), (key, f"{same}\n{b}"), (key, f"{c}\n{same}"), (8, f"{same}\n{d}")]
    kept = [r["text"] for r in ld.dedup_documents(docs(*[(*r, "en", "s") for r in rows])).collect()]
    assert len(kept) == 4 and sorted(x for t in kept for x in t.split("\n")) == sorted([a, b, c, d, same])


def test_sketch_bound():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, 300, dtype=np.uint32)
    for keep in range(0, 301, 20):
        b = np.concatenate((a[:keep], rng.integers(0, 1 << 32, 300 - keep, dtype=np.uint32)))
        n, bits = near.sketches(np.concatenate((a, b)), np.repeat([0, 1], 300), 2)
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= apart and n.tolist() == [len(set(a.tolist())), len(set(b.tolist()))]


def near_sketches(rng, n, size=300, edits=12):
    base = rng.integers(0, 1 << 32, size, dtype=np.uint32)
    sets = [np.concatenate((base[edits:], rng.integers(0, 1 << 32, rng.integers(1, edits + 1), dtype=np.uint32))) for _ in range(n)]
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    return near.sketches(np.concatenate(sets), owner, n)


@pytest.mark.parametrize("most", [2, 10_000])
@pytest.mark.parametrize("sliced", [8, 10_000])
def test_closest_links(monkeypatch, most, sliced):
    monkeypatch.setattr(near, "SLICED", sliced)
    rng = np.random.default_rng(5)
    n, bits = near_sketches(rng, 150)
    far, far_bits = near_sketches(rng, 50)
    n, bits = np.concatenate((n, far)), np.concatenate((bits, far_bits))
    ids, root = rng.permutation(200), rng.integers(0, 3, 200)
    apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2, dtype=np.int64)
    ok = (apart <= near._too_far(n[:, None] + n[None], 0.8)) & (root[:, None] != root[None])
    for split in (None, 120):
        left, right = (slice(0, split), slice(split, None)) if split else (slice(None), None)
        side = lambda s: (ids[s], root[s], n[s], bits[s])
        a, b, more = near.closest_links(side(left), side(right) if split else None, most, 0.8)
        expected = set()
        for i in range(200)[left]:
            mates = sorted((apart[i, j], ids[j]) for j in (range(200)[right] if split else range(i)) if ok[i, j])
            expected |= {(max(ids[i], j), min(ids[i], j)) for _, j in mates[:most]}
        assert set(zip(a.tolist(), b.tolist())) == expected and len(expected) > 100 and more == (most == 2)


def test_small_groups_are_compared_together():
    rng = np.random.default_rng(10)
    n, bits = near_sketches(rng, 200)
    root, sizes = rng.integers(0, 4, 200), np.array([2, 30, 2, 64, 1, 101])
    starts = np.cumsum(sizes) - sizes
    side = (np.arange(200), root, n, bits)
    for most in (2, 1000):
        a, b, cut = near.small_links(starts, sizes, side, most, 0.8)
        pairs, more = set(), set()
        for k, (s, e) in enumerate(zip(starts, starts + sizes)):
            x, y, left = near.closest_links(tuple(c[s:e] for c in side), None, most, 0.8)
            pairs |= set(zip(x.tolist(), y.tolist()))
            more |= {k} if left else set()
        assert set(zip(a.tolist(), b.tolist())) == pairs and set((np.searchsorted(starts, cut, side="right") - 1).tolist()) == more


def test_common_ends_prove_what_is_alike():
    rng = random.Random(11)
    assert near.common_ends("abcxyz", "abqyz") == (2, 2) and near.common_ends("aa", "aaa") == (2, 0) and near.common_ends("", "a") == (0, 0)
    accepted = 0
    for _ in range(300):
        x = sentence(rng, rng.randrange(1, 40))
        y = edited(rng, x, rng.randrange(5)) if rng.random() < 0.8 else sentence(rng, 20)
        if rng.random() < 0.2:
            x, y = x.replace("a", "日"), y.replace("a", "日")
        a, b = ld.shingles(x), ld.shingles(y)
        exact = len(a & b) >= 0.8 * len(a | b)
        start, end = near.common_ends(ld.normalise(x), ld.normalise(y))
        sure = near.surely_alike(len(a), len(b), *(len(ld.normalise(z)) - start - end + 6 for z in (x, y)), 0.8)
        assert ld.alike(x, y, len(a), len(b), {}) == exact and exact >= sure
        accepted += sure
    assert accepted > 50


def test_closest_links_of_a_large_group_stay_small():
    rng = np.random.default_rng(6)
    n, bits = near_sketches(rng, 16_000)
    root = np.zeros(16_000, np.int64)
    root[:300] = np.arange(300) + 1
    tracemalloc.start()
    a, _, more = near.closest_links((np.arange(300), root[:300], n[:300], bits[:300]), (np.arange(300, 16_000), root[300:], n[300:], bits[300:]), 4, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == 1200 and more and peak < 500 << 20


def test_abandoned_planes():
    rng = np.random.default_rng(7)
    a, b = (rng.integers(0, 1 << 63, (70, near.SKETCH // 64), dtype=np.uint64) for _ in range(2))
    assert near.sliced_distances(near._planes(a), b, 200) is None  # about half of all bits differ
    assert (near.sliced_distances(near._planes(a), b, near.SKETCH)[:, :70] == np.bitwise_count(b[:, None] ^ a[None]).sum(2)).all()


def test_keys_of_a_slice_are_grouped_first():
    rng = np.random.default_rng(8)
    ids, keys = rng.permutation(300).astype(np.int64), rng.integers(-1 << 63, 1 << 63, (300, near.BANDS))
    keys[:100, 3] = 77
    keys[100:103, 5] = -9
    rows = near.key_blocks(keys, ids, 8).to_pylist()
    shape = lambda r: np.frombuffer(r["block"], np.int64).reshape(3 if r["grouped"] else 2, -1)
    whole = [shape(r) for r in rows if r["grouped"]]
    assert len(whole) == 1 and set(whole[0][1]) == set(ids[:100]) and set(whole[0][2]) == {ids[:100].min()} and set(whole[0][0]) == {77}
    sent = {(k, i) for r in rows if not r["grouped"] for k, i in shape(r).T.tolist()}
    every = {(int(k), int(i)) for i, ks in zip(ids, keys) for k in ks}
    assert every - sent == {(77, int(i)) for i in ids[:100]} - {(77, int(ids[:100].min()))} and sent <= every
    pairs = {(x["a"], x["b"]) for batch in near._starred([shape(r) for r in rows if not r["grouped"]]) for x in batch.to_pylist() if x["kind"] == 0}
    assert pairs == {(int(i), int(ids[100:103].min())) for i in ids[100:103]} - {(int(ids[100:103].min()),) * 2}


def test_id_filter(spark):
    rng = np.random.default_rng(9)
    ids = rng.integers(-1 << 63, 1 << 63, 5000)
    bits = near.id_filter(spark.createDataFrame([(int(i),) for i in ids], "id long")).value
    assert near.may_hold(bits, ids).all() and near.may_hold(bits, rng.integers(-1 << 63, 1 << 63, 20_000)).mean() < 0.05


@pytest.mark.parametrize("length", [12, 40, 200])
def test_bands_find_what_is_similar(length):
    rng = random.Random(length)
    found, pairs = 0, 0
    while pairs < 400:
        x = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(length))
        y = list(x)
        for _ in range(rng.randrange(1, 3)):
            y[rng.choice((0, 1, -1, -2))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        a, b = ld.shingles(x), ld.shingles("".join(y))
        if 0.8 <= len(a & b) / len(a | b) < 1:
            keys = ld.shingle_keys([ld.normalise(x), ld.normalise("".join(y))])
            found += bool((keys[0] == keys[1]).any())
            pairs += 1
    assert found >= 0.99 * pairs


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    rng = random.Random(7)
    base = sentence(rng, 300)
    texts = [*corpus(3, 60), *[edited(rng, base, 1) for _ in range(80)], "one two", "ONE two"]
    rows = [(k + 1, t, "en", "s") for k, t in enumerate(texts)] + [(0, base, "en", "s")]
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    links = [(a, b) for a in fps for b in fps if b < a and (fps[a] ^ fps[b]).bit_count() <= 2]
    expected = classes(fps, links)
    got = simhash.simhash_components(docs(*rows).withColumn("fp", F.lit(0))).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert simhash.simhash_components(docs(*rows).limit(0)).count() == 0


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps[100:200] = fps[:100] ^ np.uint64(1) ^ (np.uint64(1) << rng.integers(1, 64, 100, dtype=np.uint64))
    for radius in (0, 1, 2, 5, 20):
        i, j = simhash.block_links(fps, radius)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(300) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= radius}
        assert simhash.pair_links(fps[:150], fps[150:], radius).tolist() == [int(a ^ b).bit_count() <= radius for a, b in zip(fps[:150], fps[150:])]


@pytest.mark.parametrize("block", [2, 2048])
def test_fingerprint_blocks(spark, block):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(200)}
    fps |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in list(fps)[:80] for _ in range(3)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, block).collect()
    expected = classes(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 2])
    assert classes(signed, [(r["u"], r["v"]) for r in edges]) == expected


def brute_similar(rows):
    sets = {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        sets[key] = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return classes(sets, [(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])


def test_similarity_classes(spark, docs):
    rng = random.Random(9)
    bases = [sentence(rng, 150) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate([*bases, *[edited(rng, rng.choice(bases), rng.randrange(1, 5)) for _ in range(120)], None, "", "x", "x y", "X  y\n", bases[0]])]
    expected = brute_similar(rows)
    df = docs(*[(*r, "en", "s") for r in rows]).withColumn("row_key", F.lit("clash"))
    got = simhash.similar_classes(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == expected
    kept = simhash.remove_near_duplicates(df.unionByName(df.filter("doc_id < 3")))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))
    assert simhash.remove_near_duplicates(df.limit(0)).count() == 0


def test_similar_texts_with_far_fingerprints(spark, docs):
    rng = random.Random(13)
    rows = []
    for k in range(12):
        body, phrase = sentence(rng, 300), sentence(rng, 4)
        rows += [(2 * k, f"{body} {phrase}"), (2 * k + 1, f"{body} " + " ".join([phrase] * 50))]
    fps = [brute_fingerprint(t, 5) for _, t in rows]
    assert any((a ^ b).bit_count() > 20 for a, b in zip(fps[::2], fps[1::2]))
    got = simhash.similar_classes(docs(*[(*r, "en", "s") for r in rows])).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_similar(rows) == {k: k - k % 2 for k in range(24)}


def test_similar_texts_are_linked_by_their_fingerprints(spark, docs, monkeypatch):
    """Without any band of min-wise values, those within the radius are found by SimHash alone, and only where the exact similarity confirms it."""
    rng = random.Random(17)
    bases = [sentence(rng, 400) for _ in range(6)]
    word = sentence(rng, 1)
    rows = list(enumerate([*bases, *[edited(rng, rng.choice(bases), 1) for _ in range(30)], *[f"{sentence(rng, 60)} " + " ".join([word] * 400) for _ in range(8)], None, "", bases[0]]))
    fps = {k: brute_fingerprint(t, 5) for k, t in rows if t}
    near = [(a, b) for a in fps for b in fps if b < a and (fps[a] ^ fps[b]).bit_count() <= 3]
    sets = {k: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows if t}
    links = [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    words = [k for k, t in rows if t]
    expected = classes(words, links)
    assert len(set(expected.values())) < len(words) - 10 and len(links) < len(near) and classes(words, near) != expected
    monkeypatch.setattr(simhash, "_similar_keys", lambda docs, width: docs.sparkSession.createDataFrame([], simhash.BLOCKS))
    got = {r["doc_id"]: r["class_id"] for r in simhash.similar_classes(docs(*[(*r, "en", "s") for r in rows])).collect()}
    assert {k: got[k] for k in words} == expected and got[len(rows) - 2] == got[len(rows) - 3] == len(rows) - 3


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 20_000])
def test_repeats(spark, docs, hot):
    rng = random.Random(11)
    passages = [sentence(rng, 80) for _ in range(4)]
    texts = []
    for _ in range(60):
        p = rng.choice(passages)
        a = rng.randrange(len(p))
        texts.append(sentence(rng, rng.randrange(60)) + p[a : a + rng.randrange(150, 420)] + sentence(rng, rng.randrange(60)))
    same = sentence(rng, 40)[:199]
    texts += [texts[0], texts[0], None, "", "q" * 199, "q" * 1500, "ab" * 300, same, same, "é" * 150, passages[0] + passages[0]]
    df = docs(*texts).withColumn("kept", F.lit(1))
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sorted(repeats.remove_repeats(df, hot).collect(), key=lambda r: r["doc_id"])]
    assert got == brute_repeats(texts)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_long_text_is_cut(monkeypatch, spark, docs):
    rng = random.Random(12)
    monkeypatch.setattr(repeats, "CHUNK", 500)
    long = sentence(rng, 600)
    parts = [x for group in repeats._segments([long.encode(), b"x"]) for x in group]
    windows = {a + i for k, a, b in parts if k == 0 for i in range(len(b) - 199)}
    assert windows == set(range(len(long.encode()) - 199))
