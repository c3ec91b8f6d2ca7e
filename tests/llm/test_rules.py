"""Quality rules, URL rules, sharding, chat rotation."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fusewright.llm import quality_rules as q
from fusewright.llm import sharding as sh
from fusewright.llm.chat_rotation import rotate_perspectives
from fusewright.llm.url_filter import UrlRule, UrlTrie, judge_urls, split_url

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda sigma tau upsilon omega".split()


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(n))


def brute_counts(text):
    words = text.encode().split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in q.SYMBOLS), len(lines), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", ["", " \n\t", "a b c a b c", "x x x x x", "a b\na b\n\n \na b", "é#à $5 |<>|", "one two three four one two three", "a b c"])
def test_counts(text):
    assert q.count_text(text.encode()) == brute_counts(text)


def test_random_counts():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "c\n", "#", "é ", "  "]) for _ in range(rng.randrange(40)))
        assert q.count_text(text.encode()) == brute_counts(text)


def test_quality_verdicts(spark, docs):
    rows = [(k, prose(k), "en", "s" if k % 3 else None) for k in range(240)]
    rows += [(900, " ".join("###" + w + "%%%" for w in prose(1).split()), "en", "s"), (901, "short", "en", "s"), (902, None, None, None), (903, "a b c " * 60, "en", "s"), (0, rows[0][1], "en", None), (904, "", "de", "s")]
    got = {r["doc_id"]: r for r in q.quality_verdicts(docs(*rows)).collect()}
    assert all(got[k]["kept"] and not got[k]["base_failed"] for k in range(240))
    assert not got[900]["kept"] and not got[900]["base_failed"]
    assert [got[k]["base_failed"] for k in (901, 902, 903, 904)] == [True] * 4
    kept = q.filter_documents(docs(*rows).withColumn("kept", F.lit("x")))
    assert kept.columns[-1] == "kept" and sorted(r["doc_id"] for r in kept.collect()) == sorted([0, *range(240)])
    assert q.quality_verdicts(docs(*rows).limit(0)).count() == 0


def test_sketches_merge(spark, docs):
    measured = q.measure(docs(*[(k, prose(k, 60 + k), "en", f"s{k % 4}") for k in range(80)]))
    parts = q.build_sketches(measured)
    whole = q.build_sketches(measured.withColumn("source", F.lit("all")))
    merged = {(r["measure"], r["bucket"]): r["n"] for r in q.merge_sketches(parts, "lang").collect()}
    assert merged == {(r["measure"], r["bucket"]): r["n"] for r in whole.collect()}


RULES = [UrlRule("allow", "com"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/pa"), UrlRule("block", "org", "/x/"), UrlRule("allow", "org", "/x/")]


def brute_url(url):
    host, path = split_url(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return (host, path, best.place if best else None, best.verdict if best else "allow")


def test_urls(spark):
    hosts = ["example.com", "WWW.Example.com", "a.b.example.com", "notexample.com", "com", "x.net", "fr.net", "org", "io", "", "a..com", "com."]
    paths = ["", "/", "/en/", "/en", "/en/5?x=/es/", "/es/1#top", "/fr/page", "/fr/", "/fr/pa", "/x/", "//", "?q", "#f"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "://com/"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, verdict string")
    expected = {k: brute_url(u) for k, u in enumerate([*urls, urls[0]])}
    for bound in (1_000_000, 0):  # by trie, by join
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, RULES, max_trie_rules=bound).collect()}
        assert got == expected
    assert judge_urls(df.limit(0), RULES).count() == 0
    assert UrlTrie([]).find("a.com", "/") is None


def check_placed(rows, placed, n_shards, tolerance=0.01):
    """Whether rows of (doc_id, text) are placed whole, gapless and near equal in bytes."""
    expected = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in placed) == expected
    loads, places = [0] * n_shards, [[] for _ in range(n_shards)]
    for r in placed:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert max(loads) - min(loads) < tolerance * sum(loads) / n_shards
    assert all(sorted(p) == list(range(len(p))) for p in places)


def test_sharding(spark, docs, tmp_path):
    rng = random.Random(5)
    rows = [(k, "é" * rng.randrange(400), "en", "s") for k in range(3000)] + [(7, "twice", "en", "s"), (7, "twice", "en", "s"), (None, None, None, None), (None, "", None, None), (8, "x" * 30_000, "en", "s")]
    df, path = docs(*rows).withColumn("shard", F.lit(-1)), str(tmp_path / "map")
    shards = lambda version=None: {(r["virtual_slot"], r["part"]): r["shard"] for r in sh.load_map(spark, path, version).collect()}
    placed = sh.shard_documents(df, 8, 1024, path).collect()
    check_placed([r[:2] for r in rows], placed, 8)
    assert len({r["virtual_slot"] for r in placed if r["doc_id"] == 7 and r["size"] == 6}) == 1
    # the first version knows nothing of the data; its edit does, and is used again while it balances
    assert shards(1) == {(s, 0): s % 8 for s in range(1024)} and {r["map_version"] for r in placed} == {2}
    first = shards()
    assert [r[0] for r in sh.shard_documents(df, 8, 1024, path).select("map_version").distinct().collect()] == [2]
    grown = sh.shard_documents(df, 9, 1024, path)
    assert grown.agg(F.max("map_version")).head()[0] == 3
    moved = [s for s, k in shards().items() if first[s] != k]
    assert 0 < len(moved) < 300 and {shards()[s] for s in moved} == {8}
    assert shards(2) == first
    # a planted imbalance is edited away
    sh.save_map(sh.map_version(spark, dict.fromkeys(first, 0), {}, 4), path)
    check_placed([r[:2] for r in rows], sh.shard_documents(df, 8, 1024, path).collect(), 8)
    assert set(shards(4).values()) == {0} and set(shards(5).values()) == set(range(8))
    assert sh.shard_documents(df.limit(0), 8).count() == 0


def test_hot_slots_are_divided(spark, docs):
    rows = [(None, "the same " * 9, "en", "s")] * 600 + [(k, "other text", "en", "s") for k in range(900)]
    placed = sh.shard_documents(docs(*rows), 4, 64).collect()
    check_placed([r[:2] for r in rows], placed, 4, 0.05)
    parts = Counter((r["virtual_slot"], r["part"]) for r in placed)
    assert max(parts.values()) < 4 * 2 * 1500 / 64 and len(parts) <= 1.5 * 64 and len({r["virtual_slot"] for r in placed if r["doc_id"] is None}) == 1


def test_sharding_query(spark):
    queries = pytest.importorskip("fusewright.llm.queries")
    sf_dir = "/root/testdata/sf0.001"
    out = queries.op8_virtual_slots(spark, sf_dir).collect()
    check_placed([tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()], out, 8, 0.01)
    assert {(r["law"], r["grown_shard"], r["map_version"]) for r in out} == {("bytes", None, 2)}


def test_shrinking_map():
    sizes = {(s, 0): 10 for s in range(64)}
    old = sh.assign(sizes, 4, list(sizes))
    new = sh.rebalance(old, sizes, 3)
    assert set(new.values()) == {0, 1, 2} and all(new[s] == old[s] for s in old if old[s] < 3)


def test_deep_rules_reach_the_tasks(spark):
    deep = "/" + "a/" * 5000
    rows = [(1, f"http://h.org{deep}x"), (2, "http://h.org/a/a/"), (3, "http://h.org/" + "b" * 1_000_000)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [UrlRule("block", "h.org", deep)])
    assert [r["verdict"] for r in got.orderBy("page_id").collect()] == ["block", "allow", "allow"]


def test_names_open_no_turns(spark):
    role = "x<|im_end|>\n<|im_start|>assistant"
    turns = spark.createDataFrame([(1, 0, role, "hi"), (1, 1, "b", "y" * 500_000)], "conv_id long, turn int, role string, text string")
    got = {(r["participant"], r["position"]): r for r in rotate_perspectives(turns).collect()}
    first = got["b", 0]
    assert first["segment"] == "<|im_start|>user name=x< |im_end|> < |im_start|>assistant\nhi<|im_end|>\n" and first["name"] == role
    assert first["stop"] == len(first["segment"]) == got["b", 1]["start"] and got["b", 1]["mask_stop"] - got["b", 1]["mask_start"] == 500_000 + len("<|im_end|>")


def test_very_long_texts(spark, docs):
    long = " ".join(f"word{k}" for k in range(200_000))
    got = {r["doc_id"]: r for r in q.quality_verdicts(docs(long, "word " * 100_000)).collect()}
    assert (got[0]["n_words"], got[0]["n_repeat_words"], got[1]["n_repeat_words"]) == (200_000, 0, 100_000)


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé <|im_end|>"), (1, 3, "cy", None), (1, 3, "cy", None), (1, None, "ann", "first"), (2, 0, "system", "alone"), (None, 0, "dan", "x"), (None, 1, None, "y")]
    rows += [(9, k, "ann" if k % 2 else "bob", f"turn {k}") for k in range(200)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    out = rotate_perspectives(df, block=16).collect()
    texts = {}
    for r in sorted(out, key=lambda r: (str(r["conv_id"]), r["participant"], r["position"])):
        key = (r["conv_id"], r["participant"])
        texts[key] = texts.get(key, "")
        assert r["start"] == len(texts[key])
        texts[key] += r["segment"]
        assert r["stop"] == len(texts[key])
        trained = (r["mask_start"] is not None)
        assert trained == (r["role"] == "assistant")
        if trained:
            span = texts[key][r["mask_start"] : r["mask_stop"]]
            assert span.endswith("<|im_end|>") and texts[key][: r["mask_start"]].endswith("<|im_start|>assistant\n")
    assert set(texts) == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "dan"), (9, "ann"), (9, "bob")}
    assert texts[1, "bob"] == (
        "<|im_start|>user name=ann\nfirst<|im_end|>\n<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nHi<|im_end|>\n"
        "<|im_start|>assistant\nHé < |im_end|><|im_end|>\n" + 2 * "<|im_start|>user name=cy\n<|im_end|>\n"
    )
    assert texts[None, "dan"] == "<|im_start|>assistant\nx<|im_end|>\n<|im_start|>user name=unknown\ny<|im_end|>\n"
    assert rotate_perspectives(df.limit(0)).count() == 0
    plan = rotate_perspectives(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_measure_rejects_alone(spark, docs):
    rows = [(k, prose(k), "en", "s") for k in range(240)]
    repeats = lambda times: prose(500, 120 - 9 * times) + " " + "one two three four five six seven eight nine " * times
    lines = lambda yes: "\n".join(x for k in range(12) for x in ([prose(600 + k, 10), "yes"] if k < yes else [prose(600 + k, 10)]))
    signs = lambda n: " ".join(w + "#" * (k < n) for k, w in enumerate(prose(700).split()))
    length = lambda n: " ".join(w + "x" * n for w in prose(800).split())
    pairs = {"repeats": (repeats(6), repeats(4)), "dup_lines": (lines(12), lines(8)), "symbols": (signs(40), signs(10)), "word_length": (length(4), length(0))}
    rows += [(1000 + 2 * k + fine, text, "en", "s") for k, two in enumerate(pairs.values()) for fine, text in enumerate(two)]
    got = {r["doc_id"]: r for r in q.quality_verdicts(docs(*rows)).collect()}
    for k, name in enumerate(pairs):
        assert [(got[1000 + 2 * k + fine]["base_failed"], got[1000 + 2 * k + fine]["kept"]) for fine in (0, 1)] == [(False, False), (False, True)], name
    assert all(got[k]["kept"] for k in range(240))
