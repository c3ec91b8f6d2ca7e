"""Quality rules whose thresholds come from mergeable quantile sketches.

Each document is measured once. Per (lang, source) and measure, a log-linear
histogram keeps the counts of buckets of relative width 2**-6: two sketches merge
by adding counts, so Spark's partial aggregation builds them in place and a hot
source costs no more than any other. Fences (quartile -/+ ``SPREAD`` times the
interquartile range, which is at least a floor) are read off the merged sketches
and joined back to the documents. Groups of under ``MIN_GROUP`` documents use the
sketch of their language, and rare languages that of all documents.

Defined results: a null text is an empty one; null ``lang`` or ``source`` is a group
of its own; very long texts are counted whole; empty tables give empty results; rows are judged one by one, so repeated
rows get the same verdict; other columns are ignored (``measure``) or carried in a
struct, where no name can clash (``filter_documents``).
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize
from fusewright.llm.common import map_batches, utf8

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Measures in thousandths: numerator, denominator, least interquartile range. ``SPREAD`` times the least range is inside what a measure can reach (repeats fail the base rule
#: above 500), so every fence can reject, and beyond what clean texts reach.
MEASURES = {
    "word_length": ("word_chars", "n_words", 150),
    "symbols": ("n_symbols", "n_words", 25),
    "dup_lines": ("n_dup_lines", "n_lines", 75),
    "repeats": ("n_repeat_words", "n_words", 70),
}
MIN_WORDS, SPREAD, MIN_GROUP = 50, 6, 200
#: Thresholds are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 50_000


def count_text(raw: bytes) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one UTF-8 text."""
    words = raw.split()
    text = raw.decode("utf-8", "replace")
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        found = Counter(grams)
        end = 0  # words before this position are counted
        for i, g in enumerate(grams):
            if found[g] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [count_text(x) for x in utf8(batch.column("text"))]
    rest = [n for n in batch.schema.names if n != "text"]
    columns = [batch.column(n) for n in rest] + [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
    return pa.RecordBatch.from_arrays(columns, [*rest, *COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and ``COUNTS`` of each row."""
    slim = docs.select("doc_id", "lang", "source", "text")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    return map_batches(slim, _counted, f"{kept}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _values(df: DataFrame) -> DataFrame:
    values = {m: F.when(F.col(d) > 0, F.floor(F.col(n) * 1000 / F.col(d))).otherwise(0).cast("long") for m, (n, d, _) in MEASURES.items()}
    return df.withColumns({f"v_{m}": v for m, v in values.items()})


def build_sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket (its least value) and count, over the rows that pass the base rules."""
    stacked = ", ".join(f"'{m}', v_{m}" for m in MEASURES)
    values = _values(measured.filter(~base_failed())).selectExpr("lang", "source", f"stack({len(MEASURES)}, {stacked}) AS (measure, v)")
    shift = "greatest(length(bin(v)) - 7, 0)"
    return values.groupBy("lang", "source", "measure", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})").alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups: counts of equal buckets add up."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, *keys: str) -> DataFrame:
    """Per group: its size and the lowest and highest value allowed for each measure."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "measure")
    ranked = sketches.select(*keys, "measure", "bucket", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    quartiles = ranked.groupBy(*keys, "measure").agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))
    floor = F.create_map(*[F.lit(x) for m, (_, _, least) in MEASURES.items() for x in (m, least)])
    spread = F.greatest(F.col("q3") - F.col("q1"), floor[F.col("measure")])
    limits = quartiles.select(*keys, "measure", "total", (F.col("q1") - SPREAD * spread).alias("low"), (F.col("q3") + SPREAD * spread).alias("high"))
    of = lambda c, m: F.max(F.when(F.col("measure") == m, F.col(c))).cast("long")
    return limits.groupBy(*keys).agg(F.max("total").alias("group_rows"), *[of(c, m).alias(f"{c}_{m}") for m in MEASURES for c in ("low", "high")])


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row per (lang, source): the fences of the group, of its language if it is small, or of all."""
    names = [f"{c}_{m}" for m in MEASURES for c in ("low", "high")]
    own = fences(sketches, "lang", "source")
    by_lang = fences(merge_sketches(sketches, "lang"), "lang").select(F.col("lang").alias("l_lang"), F.col("group_rows").alias("l_rows"), *[F.col(n).alias(f"l_{n}") for n in names])
    overall = fences(merge_sketches(sketches.withColumn("every", F.lit(1)), "every"), "every").select("every", *[F.col(n).alias(f"a_{n}") for n in names])
    joined = own.withColumn("every", F.lit(1)).join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(overall), "every")  # one row
    pick = lambda n: F.when(F.col("group_rows") >= MIN_GROUP, F.col(n)).when(F.col("l_rows") >= MIN_GROUP, F.col(f"l_{n}")).otherwise(F.col(f"a_{n}")).alias(n)
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[pick(n) for n in names])


def judge(measured: DataFrame) -> DataFrame:
    """Adds base_failed and kept to rows with lang, source and ``COUNTS``; ``measured`` should be cheap to read twice."""
    limits = materialize(thresholds(build_sketches(measured)), "thresholds")
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    joined = _values(measured).join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = [F.col(f"v_{m}").between(F.col(f"low_{m}"), F.col(f"high_{m}")) for m in MEASURES]
    ok = ~base_failed()
    for x in inside:
        ok = ok & F.coalesce(x, F.lit(True))
    drop = [f"v_{m}" for m in MEASURES] + limits.columns
    return joined.withColumns({"base_failed": base_failed(), "kept": ok}).drop(*drop)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed and kept."""
    return judge(materialize(measure(docs), "quality"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with their columns. The measured rows are written once, so no text is shuffled."""
    wrapped = docs.select(F.struct("*").alias("row"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column("row")
        counts = [count_text(x) for x in utf8(row.field("text"))]
        columns = [row, *[pa.array([r[i] for r in counts], pa.int64()) for i in range(len(COUNTS))]]
        return pa.RecordBatch.from_arrays(columns, ["row", *COUNTS])

    counted = map_batches(wrapped, work, f"row {wrapped.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))
    measured = materialize(counted, "quality").withColumns({"lang": F.col("row.lang"), "source": F.col("row.source")})
    return judge(measured).filter("kept").select("row.*")
