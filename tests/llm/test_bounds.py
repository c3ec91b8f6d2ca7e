"""Caches, buckets, filters and bounds stay within what they say."""

import random

import numpy as np
import public_tokenizers
import pytest

from fusewright.llm import near, packing
from fusewright.llm.common import ByteCache
from fusewright.llm.line_dedup import _Line


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_words_without_spaces_are_not_kept():
    cache = packing.WordCache(public_tokenizers.path("word_bpe_49k.json"))
    rng, before = random.Random(1), resident()
    for _ in range(3000):
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=18_000)).encode()
        assert len(cache.encode(text)) > 4000
    assert not any(len(w) > packing.CACHED_WORD for w in cache) and resident() - before < 300 << 20


def test_many_words_are_kept_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 1 << 20)
    cache = packing.WordCache(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"word{k} w{k}!" for k in range(20_000)]
    packed = [cache.encode(t.encode()) for t in texts]
    assert cache.held <= 1 << 20 and 1000 < len(cache) < 6000
    assert packed == [packing.WordCache(public_tokenizers.path("word_bpe_49k.json")).encode(t.encode()) if k % 500 == 0 else packed[k] for k, t in enumerate(texts)]


@pytest.mark.parametrize("make", [lambda x: np.arange(len(x), dtype=np.uint64)[: len(x) // 8], _Line])
def test_long_texts_are_kept_by_bytes(make):
    cache, before = ByteCache(near.CACHED_TEXTS), resident()
    for k in range(2000):
        text = f"{k:09d}" * 116_509  # a megabyte
        made = near.cached(cache, text, make)
        assert (cache.get(text) is made) and cache.held <= near.CACHED_TEXTS
    assert resident() - before < 300 << 20
    huge = "x" * (near.CACHED_TEXTS + 1)
    near.cached(cache, huge, make)
    assert huge not in cache


def test_buckets_follow_the_input(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3_000_000).selectExpr("CAST(uuid() AS STRING) AS text").write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    table = spark.read.parquet(path)
    few = near.n_buckets(table)
    assert few >= size / near.BUCKET_BYTES > 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert near.n_buckets(table) == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_filter_that_would_be_full_is_left_out(spark, monkeypatch):
    ids = spark.range(5000)
    kept = near.may_hold(near.id_filter(ids).value, np.arange(5000))
    assert kept.all() and not near.may_hold(near.id_filter(ids).value, np.arange(10**9, 10**9 + 5000)).all()
    monkeypatch.setattr(near, "FILTER_BITS", 1 << 14)
    wanted = near.id_filter(ids).value
    assert wanted == b"" and near.may_hold(wanted, np.arange(9)).all()


@pytest.mark.parametrize("lengths", ["uniform", "log-normal", "halves", "tiny", "none"])
def test_the_lower_bound_is_one(lengths):
    rng = np.random.default_rng(5)
    draw = {
        "uniform": lambda: rng.integers(1, 4097, 20_000), "log-normal": lambda: np.clip(rng.lognormal(6, 1, 20_000), 1, 4096).astype(int),
        "halves": lambda: rng.integers(1366, 2049, 20_000), "tiny": lambda: rng.integers(1, 15, 20_000), "none": lambda: np.empty(0, int),
    }[lengths]()
    histogram = dict(zip(*(x.tolist() for x in np.unique(draw, return_counts=True))))
    used = sum(r.times for r in packing.plan_runs(histogram, 4096))
    bound = packing.lower_bound(histogram, 4096)
    assert -(-int(draw.sum()) // 4096) <= bound <= used <= 1.05 * bound + 1
