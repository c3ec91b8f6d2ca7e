"""Packing, WARC archives, decontamination and the pipeline."""

import gzip
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from fusewright.llm import decontamination as de  # noqa: E402
from fusewright.llm import packing as pk  # noqa: E402
from fusewright.llm import quality_rules, warc  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_runs(histogram, capacity=4096):
    runs = pk.plan_runs(dict(histogram), capacity)
    used = {}
    for r in runs:
        assert sum(r.lengths) <= capacity and r.times > 0
        for n in r.lengths:
            used[n] = used.get(n, 0) + r.times
    assert used == {n: k for n, k in histogram.items() if k}
    return sum(r.times for r in runs)


def test_plans_are_near_the_bound():
    rng = random.Random(1)
    for n in (1, 50, 3000):
        histogram = {}
        for _ in range(n):
            length = min(4096, max(1, int(rng.lognormvariate(6, 1.2))))
            histogram[length] = histogram.get(length, 0) + 1
        bound = -(-sum(k * v for k, v in histogram.items()) // 4096)
        assert check_runs(histogram) <= max(bound + 2, 1.01 * bound)
    assert check_runs({4096: 1_000_000, 2048: 1_000_001, 1: 3}) == 1_500_001
    assert check_runs({3000: 7}) == 7 and check_runs({}) == 0
    assert check_runs({1365: 300}) == 100


def test_program_beats_best_fit_where_rooms_are_awkward():
    rng = random.Random(2)
    uniform, skewed = {}, {}
    for _ in range(250_000):
        n = rng.randrange(1000, 2000)
        uniform[n] = uniform.get(n, 0) + 1
        n = min(4096, max(1, int(rng.lognormvariate(6, 1.2))))
        skewed[n] = skewed.get(n, 0) + 1
    for histogram, most in ((uniform, 96_675), (skewed, None)):
        alone, used = sum(r.times for r in pk.fill(histogram, 4096, [])), check_runs(histogram)
        bound = -(-sum(k * v for k, v in histogram.items()) // 4096)
        assert bound <= used <= (most or 1.001 * bound) and used <= alone


def test_program_and_its_bound():
    demand = np.zeros(16, np.int64)
    demand[[8, 6]] = 60, 60  # 9 and 7 of 16 units pair exactly
    program = pk.solve_configurations(demand)
    assert 60 - 1e-6 <= program.bound + 1e-6 and program.bound <= program.objective + 1 and program.objective < 61
    covered = sum(v * f for f, v in program.fillings)
    assert (covered <= demand + 1e-6).all() and (demand - covered) @ np.arange(1, 17) < 16
    demand[:] = 0
    demand[8] = 100  # 9 of 16: one to a sequence, which bytes do not tell
    program = pk.solve_configurations(demand)
    assert abs(program.bound - 100) < 1e-6 and 99 <= program.objective <= 100 + 1e-6
    assert pk.solve_configurations(np.zeros(16, np.int64)).fillings == []


def test_knapsack():
    prices = np.zeros(16)
    prices[4], prices[2] = 5.0, 2.9  # sizes 5 and 3
    assert [int(x) for x in pk.dearest_filling(prices)[[4, 2]]] == [2, 2]


def test_word_cache():
    texts = ["it's Ünïcode İstanbul STRASSE ß don't 'll  x y áb é, <|endoftext|> (the) 12,345.6 $5% 日本語 ǅ ﬁ", "", " \n\t ", "'s't're x'S", "a'", "café... \x1c", "ÀÉ,' À'", "a b c", "in_do a__b x_ {z}|~", "ÿþýüûúùøö ÀÁÂÃÄ"]
    tokenizer, cache = Tokenizer.from_file(PATH), pk.WordCache(PATH)
    for t in texts * 2:
        assert np.frombuffer(cache.encode(t.encode()), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def brute_pieces(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out += [(key, k // 4096, k, len(p := ids[k : k + 4096]), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    return sorted(out, key=str)


def check_packed(rows, packed):
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed), key=str) == brute_pieces(rows)
    at = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 4096 for n in at.values())
    return len(at), -(-sum(at.values()) // 4096)


def test_packing(spark, docs):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "tion,", "Éa", "zq"]) for _ in range(rng.randrange(300)))) for k in range(200)]
    rows += [(1, "the"), (1, "the"), (None, None), (500, ""), (501, "word " * 20_000), *[(600 + k, "same text") for k in range(300)]]
    used, bound = check_packed(rows, pk.pack_documents(docs(*[(*r, "en", "s") for r in rows]).withColumn("length", F.lit("clash")), PATH).collect())
    assert used <= bound + 1
    assert pk.pack_documents(docs("x").limit(0), PATH).count() == 0


PAGES = "page_id long, url string, html string, record_type string"


def test_archives(spark, tmp_path):
    rng = random.Random(4)
    html = ["<p>" + "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(400))) + "</p>" for _ in range(60)]
    rows = [(k, f"http://h/{k}", html[k % 40]) for k in range(100)] + [(200, None, None), (201, "http://e", ""), (202, "http://x\r\ny", "WARC/1.1\r\n\r\n"), (None, "http://n", "<p>null id</p>"), (3, "http://h/3", html[3])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(first.get(h or "", k), k)
    expected, named = [], set()
    for k, _, h in rows:
        response = k is None or (first[h or ""] == k and h not in named)
        named |= {h} if k is not None and first[h or ""] == k else set()
        expected.append((k, len((h or "").encode()), warc.digest((h or "").encode()), "response" if response else "revisit", None if response else first[h or ""]))
    expected.sort(key=str)
    manifest = warc.write_archives(warc.record_types(df), f"file://{tmp_path}/a", roll_bytes=3000)
    assert manifest.count() > 4
    for split in (97, 1000, 1 << 25):  # ranges smaller than a record, and larger than a file
        got = warc.read_archives(manifest, split).collect()
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected
    assert {r["content"].decode() for r in got if r["record_type"] == "response"} == {h or "" for _, _, h in rows}
    assert {r["url"] for r in got} == {u for _, u, _ in rows}
    for f in (tmp_path / "a").iterdir():  # any gzip reader reads the members in turn
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")
    assert warc.archive_pages(df.limit(0), f"file://{tmp_path}/b").count() == 0
    assert warc.record_types(df, 10_000).filter("record_type = 'revisit'").count() == 0


def test_rows_that_repeat_a_page(spark, tmp_path):
    rows = [(5, f"http://{u}", "<p>same</p>") for u in "caab"] + [(7, "http://z", "<p>same</p>"), (None, "http://x", "<p>same</p>"), (None, "http://y", "<p>none named</p>"), (None, "http://y", "<p>none named</p>")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a").collect()
    assert sorted((r["record_type"], r["url"], r["refers_to"]) for r in got if r["page_id"] == 5) == [("response", "http://a", None), ("revisit", "http://a", 5), ("revisit", "http://b", 5), ("revisit", "http://c", 5)]
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got if r["page_id"] != 5) == [("7", "revisit", 5), *[("None", "response", None)] * 2, ("None", "revisit", 5)]


def test_false_magic_is_refused():
    good = warc.member("response", 1, "http://a", b"payload", None)
    fake = gzip.compress(b"not a record at all") + warc.MAGIC + b"garbage" + good[: len(good) // 2]
    data = fake + good + warc.MAGIC + good
    found = list(warc.scan_range(pa.BufferReader(data), len(data), 0, len(data)))
    assert [f[0] for f in found] == [len(fake), len(fake) + len(good) + 3]
    cut = data[: len(fake) + len(good) - 3]  # a record without its end is none
    assert not list(warc.scan_range(pa.BufferReader(cut), len(cut), 0, len(cut)))
    assert warc.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nxx\r\n\r\n") is None


def test_long_urls_and_lost_records(spark, tmp_path):
    rows = [(k, "http://h/" + "u" * n, f"<p>{k}</p>") for k, n in enumerate((5, 70_000, 3_000_000, 9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(warc.record_types(df), f"file://{tmp_path}/a")
    for split in (97, 1 << 25):
        assert sorted((r["page_id"], r["url"], r["content"].decode()) for r in warc.read_archives(manifest, split).collect()) == rows
    with pytest.raises(Exception, match="manifest"):
        warc.read_archives(manifest.withColumn("records", F.col("records") + 1)).collect()
    path = manifest.filter("records > 0").head()["path"].removeprefix("file://")
    with open(path, "r+b") as file:
        file.write(b"\0")  # the first record is none any more
    with pytest.raises(Exception, match="manifest"):
        warc.read_archives(manifest).collect()


ITEM = "A train leaves Berlin at 7 with Anna and covers 120 km before Anna meets Boris who then travels 7 more km with Carla today"


def test_leaks(spark, docs):
    benchmark = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "Too short to tell"), (3, None), (None, ITEM), (4, "plain words that hold no slot at all but are many enough to make some windows of their own")], "item_id long, text string")
    other = ITEM.replace("7", "9").replace("120", "340").replace("Anna", "Olga").replace("Boris", "Pawel").replace("Carla", "Dora").replace("Berlin", "Rome")
    mixed = "A train leaves Rome at 9 with Olga and covers 340 km before Irene meets Pawel who then travels 8 more km with Dora today"
    rows = [(10, f"Intro here. {ITEM}. The end"), (11, other), (12, mixed), (13, "nothing of the kind " * 20), (14, None), (15, ""), (16, ITEM.upper()[:60]), (17, " ".join(ITEM.split()[:5])), (None, ITEM), (18, "Plain words that hold no slot at all but are many enough to make some WINDOWS of their own"), (10, "again")]
    df = docs(*[(*r, "en", "s") for r in rows]).withColumns({"item_id": F.lit("clash"), "doc": F.lit(1), "leaked": F.lit(10)})
    got = {(r["doc_id"], r["item_id"]) for r in de.find_leaks(df, benchmark).collect()}
    assert got == {(10, 1), (11, 1), (None, 1), (18, 4)}
    kept = de.remove_contaminated(df, benchmark)
    # a row that repeats the id of a leak is judged by itself
    assert kept.columns == df.columns and sorted((r["doc_id"], (r["text"] or "")[:5]) for r in kept.collect()) == [(10, "again"), (12, mixed[:5]), (13, "nothi"), (14, ""), (15, ""), (16, ITEM.upper()[:5]), (17, ITEM[:5])]
    assert de.find_leaks(df.limit(0), benchmark).count() == 0 and de.find_leaks(df, benchmark.limit(0)).count() == 0
    assert "Python" not in de.find_leaks(df, benchmark)._jdf.queryExecution().optimizedPlan().toString()


def test_one_slot_conflict_keeps_the_rest(spark, docs):
    words = [f"q{c}{d}" for c in "abcdefgh" for d in "klmnopqrst"]
    item = " ".join([*words[:10], "asked Anna", *words[10:50], "told Anna", *words[50:]])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    name = item.replace("asked Anna", "asked Anne")
    got = {r["doc_id"]: (r["matched_windows"], r["covered_tokens"], r["item_tokens"]) for r in de.find_leaks(docs(name, item, item.replace("Anna", "Olga")), benchmark).collect()}
    # 84 tokens, 77 windows: the eight that hold 'Anne' go, and only its own token is left uncovered
    assert got == {0: (69, 83, 84), 1: (77, 84, 84), 2: (77, 84, 84)}
    assert de.remove_contaminated(docs(name), benchmark).count() == 0
    both = item.replace("asked Anna", "asked Olga").replace("told Anna", "told Irene")
    assert [(r["matched_windows"], r["covered_tokens"]) for r in de.find_leaks(docs(both), benchmark).collect()] == [(61, 82)]


def test_names_that_begin_sentences(spark, docs):
    item = "Tom has 3 apples. Ann has 5 pears. Bob has 2 plums. Who has the most fruit?"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("Tom", "Sam").replace("Ann", "Eva").replace("Bob", "Max").replace("3", "7").replace("5", "1").replace("2", "9")
    recurs = "Tom buys 3 books for 4 dollars. Tom sells 2 books again. Tom keeps what is left of them."
    twice = spark.createDataFrame([(2, recurs)], "item_id long, text string")
    got = {r["doc_id"]: (r["covered_tokens"], r["item_tokens"]) for r in de.find_leaks(docs(item, other, other.replace("apples", "stones").replace("pears", "coins").replace("plums", "shells")), benchmark).collect()}
    assert got == {0: (17, 17), 1: (17, 17)}
    one, two = recurs.replace("Tom", "Lea"), recurs.replace("Tom buys", "Lea buys").replace("Tom sells", "Ida sells").replace("Tom keeps", "Uwe keeps")
    assert {r["doc_id"] for r in de.find_leaks(docs(one, two), twice).collect()} == {0}


def test_short_items(spark, docs):
    items = [(1, "What is the capital of France?"), (2, "Name it."), (3, "42"), (4, ITEM), (5, ""), (6, "?"), (7, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = ["So: what is the capital of France? Paris.", "what is the capital of Spain", "what is a capital", "Please name it", f"x {ITEM}", "there are 42 of them", "there are 43 of them", "", None]
    got = {(r["doc_id"], r["item_id"], r["matched_windows"], r["covered_tokens"], r["item_tokens"]) for r in de.find_leaks(docs(*rows), benchmark).collect()}
    assert got == {(0, 1, 1, 6, 6), (1, 1, 1, 6, 6), (3, 2, 1, 2, 2), (4, 4, 18, 25, 25), (5, 3, 1, 1, 1)}
    kept = de.remove_contaminated(docs(*rows), benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 6, 7, 8]


def test_rows_without_ids(spark, docs):
    other = "an item that no id names but that is long enough to make windows of its own"
    benchmark = spark.createDataFrame([(1, ITEM), (None, other)], "item_id long, text string")
    texts = [ITEM, "clean", None, f"see {other}", "clean too"]
    df = docs(*[(None, t, "en", "s") for t in texts], (5, f"{other} again", "en", "s"), (6, "clean", "en", "s"))
    assert [(r["doc_id"], r["item_id"]) for r in de.find_leaks(df, benchmark).collect()] == [(None, 1)]
    kept = de.remove_contaminated(df, benchmark).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == [("6", "clean"), ("None", "None"), ("None", "clean"), ("None", "clean too")]


def test_pipeline(spark, docs, tmp_path):
    from test_dedup import brute_lines, brute_similar, edited, sentence

    rng = random.Random(6)
    rows = [(k, "\n".join(sentence(rng, 30) for _ in range(4)), "en", f"s{k % 2}") for k in range(60)]
    rows += [(100 + k, edited(rng, rows[k][1], 1), "en", "s0") for k in range(10)]
    leaked = sentence(rng, 40)
    rows += [(200, rows[5][1].replace("\n", " ") + " " + leaked, "en", "s1"), (201, "too short", "en", "s0"), (202, " ".join("###" + w for w in sentence(rng, 80).split()), "en", "s0"), (203, None, None, None)]
    df = docs(*rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    result = corpus_pipeline.run(spark, str(tmp_path))
    packed = result.collect()
    with pytest.raises(Exception, match="Path"):
        spark.read.parquet(result._stored_at.replace("best-fit-packing", "quality-rules")).count()

    kept = {r["doc_id"] for r in quality_rules.quality_verdicts(df).filter("kept").collect()}
    assert kept == {r[0] for r in rows} - {201, 202, 203}
    texts = {r[0]: r[1] for r in rows if r[0] in kept}
    gone = brute_lines(list(texts.items()))
    texts = {k: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(k, ())) for k, t in texts.items()}
    stay = set(brute_similar(list(texts.items())).values())
    texts = {k: t for k, t in texts.items() if k in stay and leaked not in t}
    used, bound = check_packed(list(texts.items()), packed)
    assert used <= bound + 1 and 200 not in texts


def test_stages_keep_the_columns(spark, docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = docs("a b", None).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns


def test_lists_of_numbers_and_names_are_no_leaks(spark, docs):
    rng = random.Random(12)
    numbers = lambda n: " ".join(str(rng.randrange(10_000, 99_999)) for _ in range(n))
    names = ["".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(3)).title() for _ in range(120)]
    items = [(k, numbers(20)) for k in range(20)] + [(100 + k, "see " + " ".join(names[20 * k : 20 * k + 18])) for k in range(3)]
    mixed = "a farmer sells 12 crates of plums to Anna for 30 dollars and then 45 crates of pears to Boris for 90 dollars"
    items += [(200, mixed), (201, "4711 1234"), (202, "Anna Boris")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    again = mixed.replace("12", "7").replace("Anna", "Clara").replace("30", "81").replace("45", "3").replace("Boris", "Denis").replace("90", "15")
    texts = [numbers(2000), "they list " + " ".join(names[60:]), "before " + items[5][1] + " after", "so: " + items[20][1], again, "1234 4711 99 4711 1234 8", "x Boris Anna y"]
    got = {(r["doc_id"], r["item_id"]) for r in de.find_leaks(docs(*texts), benchmark).collect()}
    assert got == {(2, 5), (3, 100), (4, 200), (5, 201)}


@pytest.mark.parametrize("n", [2000, 8000])
def test_lists_of_numbers_make_few_matches(spark, docs, monkeypatch, n):
    """Windows of placeholders only share no hash: twenty items of twenty numbers against one list of ``n``."""
    rng = random.Random(n)
    numbers = lambda k: " ".join(str(rng.randrange(10_000, 99_999)) for _ in range(k))
    benchmark = spark.createDataFrame([(k, numbers(20)) for k in range(20)], "item_id long, text string")
    stored, materialize = {}, de.materialize
    monkeypatch.setattr(de, "materialize", lambda df, label: stored.setdefault(label, materialize(df, label)))
    assert de.find_leaks(docs(numbers(n)), benchmark).count() == 0
    assert stored["matches"].count() < 100


def test_leaks_equal_their_sql(spark, docs):
    """Short items, lists, names at the beginning of sentences and conflicts, by the query's SQL."""
    import duckdb

    queries = pytest.importorskip("fusewright.llm.queries")
    rng = random.Random(4)
    base = ["Tom has 3 apples", "Ann buys 5 kg of pears", "who has the most fruit?", "Bob", "17 18 19 20", "What is the capital of France?", "a train leaves at 9 and goes 70 km in 2 hours.", "Eva", "the sum", "12 %", "no.", "Mia Leo Kim"]
    items = [(k, " ".join(rng.choice(base) for _ in range(rng.randrange(1, 5)))) for k in range(40)] + [(None, "a null item")]
    swap = str.maketrans("0123456789", "5550123456")
    texts = []
    for _ in range(60):
        text = " ".join(rng.choice(items)[1] for _ in range(rng.randrange(1, 3)))
        texts.append(rng.choice([text, text.translate(swap), text.replace("Tom", "Max").replace("Eva", "Ida"), text.lower(), text.replace("3", "4", 1)]))
    documents, benchmark = docs(*texts, None, ""), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    con.register("benchmark", benchmark.toPandas().astype({"item_id": "Int64"}))
    expected = con.sql(queries.ORACLE_SQL["op6_template_decontamination"])
    got = de.find_leaks(documents, benchmark)
    assert sorted(tuple(r[c] for c in expected.columns) for r in got.collect()) == sorted(expected.fetchall())
    assert got.count() > 50
