"""Null and repeated ids and very long texts in SimHash, line dedup, decontamination and WARC."""

import random

from fusewright.llm import decontamination as de
from fusewright.llm import line_dedup as ld
from fusewright.llm import simhash, warc


def words(rng, n):
    return [f"{rng.choice('bdfgklmnprstvz')}{rng.choice('aeiou')}{rng.randrange(10_000)}" for _ in range(n)]


def test_simhash_of_null_and_repeated_ids(spark, docs):
    from test_dedup import brute_fingerprint, classes

    rng = random.Random(1)
    base = words(rng, 400)
    near = [*base[:200], "other", *base[201:]]
    rows = [(5, " ".join(base)), (None, " ".join(base)), (3, " ".join(near)), (5, "a text of its own"), (None, "alone and without an id"), (7, "a text of its own"), (9, None), (2, ""), (None, " \n"), (5, " ".join(base))]
    got = sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, str(r["component_id"])) for r in simhash.simhash_components(docs(*[(*r, "en", "s") for r in rows])).collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    root = classes(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for k, (key, _) in enumerate(rows):
        least[root[k]] = min((x for x in (least.get(root[k]), key) if x is not None), default=None)
    assert got == sorted((str(key), fps[k], str(least[root[k]])) for k, (key, _) in enumerate(rows))


def test_very_long_texts(spark, docs):
    from test_dedup import brute_fingerprint

    rng = random.Random(2)
    long = words(rng, 60_000)
    text, line = " ".join(long), " ".join(words(rng, 30_000))
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs(text, text + " end", "short")).collect()}
    assert got[0]["fp"] & (1 << 64) - 1 == brute_fingerprint(text) and got[0]["component_id"] == got[1]["component_id"] == 0 and got[2]["component_id"] == 2
    # one very long line twice, once with a word changed, and a text of very many lines
    lines = [f"line {k} {w}" for k, w in enumerate(long[:20_000])]
    many = "\n".join([*lines, lines[7], lines[19_999]])
    out = {r["row"]["doc_id"]: list(r["removed"]) for r in ld.dedup_lines(docs(f"{line}\nx", f"y\n{line[:50_000]}Q{line[50_001:]}", many)).collect()}
    assert out[0] == [] and out[1] == [1] and {20_000, 20_001} <= set(out[2])
    # an item in the middle of a very long text
    item = " ".join(words(rng, 40))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    held = " ".join([*long[:30_000], item, *long[30_000:]])
    assert [(r["doc_id"], r["covered_tokens"]) for r in de.find_leaks(docs(held, text), benchmark).collect()] == [(0, r) for r in [80]]


def test_very_long_pages(spark, tmp_path):
    html = "<p>" + " ".join(words(random.Random(3), 200_000))
    pages = spark.createDataFrame([(1, "http://a/", html), (2, "http://b/", html), (3, "http://c/", "x")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in warc.archive_pages(pages, "file://" + str(tmp_path / "w")).collect()}
    assert (out[1]["record_type"], out[2]["record_type"], out[2]["refers_to"], out[1]["payload_bytes"]) == ("response", "revisit", 1, len(html)) and out[3]["payload_bytes"] == 1
