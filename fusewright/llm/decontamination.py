"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become token templates: numbers, names (title-case words) and units (a listed word after a number) become typed placeholders, other words
are lower-cased, punctuation goes. A title-case word at the beginning of a sentence may be a name or not: in a document it is
a placeholder, and an item's windows that hold one have two templates, with the word as it is and with a name supposed (open). Every window of ``WINDOW`` template tokens of a document is
hashed and joined with the benchmark's windows, so a question with other numbers or names still
matches. Matches of one alignment (document position minus item position) are slot-checked: an
item's value must stand for one value of the document wherever it recurs. Where it stands for two, windows
that hold it go, but for those whose values equal the item's; open windows are checked with the names that they suppose, others without. An item whose windows that are left cover ``COVERAGE`` of its tokens is a leak.

The benchmark's windows are broadcast while they number at most ``BROADCAST_WINDOWS``, and joined by a
shuffle beyond. Only documents with matched slots are read again, for their values.

A window of placeholders only says nothing about a question, and a list of numbers or names would match any other. Such a window is hashed by its values instead, so that
it is evidence where they are equal, and no hash is shared by all lists.

An item of fewer tokens than a window is one window of its own length, which documents have at the lengths of
such items.

Defined results: null or empty texts have no windows and never match; in ``find_leaks``, rows that repeat a doc_id count as one document, its
windows together, and rows without one are documents by their text; ``remove_contaminated`` takes every row by itself (rows equal in doc_id and text alike);
repeated benchmark rows change nothing; rows without an
item_id cannot be named in ``find_leaks``, which passes them over, but are items by their text in ``remove_contaminated``; empty tables give empty
results; very long texts are read whole; other columns are ignored or kept as they are (``remove_contaminated``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize
from fusewright.llm.common import let

#: Tokens of a window. An item of fewer is one window.
WINDOW = 8
COVERAGE = 0.5
BROADCAST_WINDOWS = 2_000_000
BROADCAST_DOCS = 500_000
#: Units of measure that may follow a number, lower-case.
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent degree degrees mph kmh watt watts volt volts"
).split()
TOKEN = r"\$?[0-9]+(?:[.,][0-9]+)*%?|[\p{L}\p{M}]+|[.!?\n]"
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _ends(x: Column) -> Column:
    return (x < "$") | (x == ".") | (x == "?")


def _template(x: Column, before: Column, supposed: bool) -> Column:
    """Template of a token after another; null for a sentence's end. ``supposed``: title-case words that begin a sentence are names."""
    number = lambda y: (y >= "$") & (y < ":") & (y != ".")

    def word(low: Column) -> Column:
        title = (low != x) & (F.length(x) > 1) & (F.substring(x, 2, 1 << 20) == F.substring(low, 2, 1 << 20))
        if not supposed:
            title = title & before.isNotNull() & ~_ends(before)
        return F.when(number(before) & low.isin(UNITS), UNIT).when(title, NAME).otherwise(low)

    return F.when(_ends(x), None).when(number(x), NUMBER).otherwise(let(F.lower(x), word))


def templates(df: DataFrame, key: str, supposed: bool = True, name: str = "hashes") -> DataFrame:
    """key, hashes (of the template tokens) and values (of the tokens as they are) of each row."""
    ended = F.xxhash64(F.lit(None).cast("string"))  # what a sentence's end hashes to
    hashed = lambda t: F.filter(F.transform(t, lambda x, i: F.xxhash64(_template(x, F.get(t, i - 1), supposed))), lambda h: h != ended)
    values = lambda t: F.transform(F.filter(t, lambda x: ~_ends(x)), lambda x: F.xxhash64(x))
    both = let(_tokens(F.col("text")), lambda t: F.struct(hashed(t).alias("h"), values(t).alias("v")))
    return df.select(key, both.alias("x_")).select(key, F.col("x_.h").alias(name), F.col("x_.v").alias("values"))


def _is_slot(h: Column) -> Column:
    return reduce(lambda a, b: a | b, [h == F.xxhash64(F.lit(x)) for x in (NUMBER, NAME, UNIT)])


def windows(hashed: DataFrame, key: str, *widths: int, hashes: str = "hashes") -> DataFrame:
    """key, position (from 0) and hash of every window of ``widths`` template tokens; of placeholders only, by their values."""

    def of(x: Column, width: int) -> Column:
        def window(h: Column, i: Column) -> Column:
            bare = reduce(lambda a, b: a & b, [_is_slot(h), *[_is_slot(F.get(x["h"], i + k)) for k in range(1, width)]])  # most end at the first token
            return F.when(bare, F.xxhash64(F.lit("values"), *[F.get(x["v"], i + k) for k in range(width)])).otherwise(F.xxhash64(h, *[F.get(x["h"], i + k) for k in range(1, width)]))

        return F.transform(F.slice(x["h"], 1, F.greatest(F.size(x["h"]) - (width - 1), F.lit(0))), window)

    both = F.struct(F.col(hashes).alias("h"), F.col("values").alias("v"))
    if len(widths) == 1:
        return hashed.select(key, F.posexplode(let(both, lambda x: of(x, widths[0]))).alias("position", "hash"))
    placed = lambda x: F.concat(*[F.transform(of(x, w), lambda h, i: F.struct(i.alias("position"), h.alias("hash"))) for w in widths])
    return hashed.select(key, F.explode(let(both, placed)).alias("x")).select(key, "x.*")


def slot_values(df: DataFrame, key: str) -> DataFrame:
    """key, at (position), kind, open and value of each slot: a number, unit or title-case word; open ones begin a sentence."""
    of = lambda t, x, i: F.struct(_template(x, F.get(t, i - 1), True).alias("kind"), _template(x, F.get(t, i - 1), False).alias("sure"), x.alias("value"))
    all_ = let(_tokens(F.col("text")), lambda t: F.transform(t, lambda x, i: of(t, x, i)))
    rows = df.select(key, F.posexplode(F.filter(all_, lambda t: t["kind"].isNotNull())).alias("at", "t"))
    return rows.filter(F.col("t.kind").isin(NUMBER, NAME, UNIT)).select(key, "at", "t.kind", (F.col("t.kind") != F.col("t.sure")).alias("open"), "t.value")


def _inconsistent(matches: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc, item_id, shift and open of the alignments with changed values, with the item's positions of values that stand for two of the document (clash) and of values that differ (changed)."""
    ids = materialize(matches.select("doc").distinct(), "ids")
    few = ids.count() <= BROADCAST_DOCS
    theirs = slot_values(docs.join(F.broadcast(ids) if few else ids, F.col("doc") == F.col("doc_id"), "left_semi"), "doc_id").select(F.col("doc_id").alias("d"), "at", F.col("value").alias("doc_value"))
    ours = slot_values(items, "item_id").select(F.col("item_id").alias("i"), F.col("at").alias("item_at"), "kind", F.col("open").alias("supposed"), F.col("value").alias("item_value"))
    # what supposes no names is checked without them, and once more with them, for the windows that do
    ways = F.explode(F.when(F.col("open"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("open")
    places = matches.select("doc", "item_id", "shift", "item_position", "width", ways)
    places = places.select("doc", "item_id", "shift", "open", F.explode(F.sequence("item_position", F.col("item_position") + F.col("width") - 1)).alias("item_at")).distinct()
    pairs = places.join(ours, (F.col("i") == F.col("item_id")) & (ours["item_at"] == places["item_at"]) & (F.col("open") | ~F.col("supposed")))
    pairs = pairs.select("doc", "item_id", "shift", "open", places["item_at"].alias("place"), "kind", "item_value")
    pairs = pairs.join(theirs, (F.col("doc") == F.col("d")) & (F.col("at") == F.col("place") + F.col("shift")))
    # both lists are at most an item's tokens
    changed = F.collect_set(F.when(F.col("item_value") != F.col("doc_value"), F.col("place")))
    mapped = pairs.groupBy("doc", "item_id", "shift", "open", "kind", "item_value").agg(F.min("doc_value").alias("a"), F.max("doc_value").alias("b"), F.collect_set("place").alias("places"), changed.alias("changed"))
    clash = F.flatten(F.collect_list(F.when(F.col("a") != F.col("b"), F.col("places"))))
    return mapped.groupBy("doc", "item_id", "shift", "open").agg(clash.alias("clash"), F.flatten(F.collect_list("changed")).alias("changed")).filter(F.size("changed") > 0)


def _item_templates(items: DataFrame) -> DataFrame:
    """item_id, hashes, supposed (with names at the beginning of sentences) and values."""
    texts = items.select(F.struct("item_id", "text").alias("row"), "text")
    sure = templates(texts, "row", False)
    return templates(sure.select(F.struct("row.item_id", "hashes").alias("kept"), "row.text"), "kept", True, "supposed").select("kept.*", "supposed", "values")


def _doc_key(every_row: bool) -> Column:
    """A document, never null: its doc_id, and its text if it has none or every row is one."""
    return F.struct("doc_id", F.when(F.lit(every_row) | F.col("doc_id").isNull(), F.xxhash64("text")).alias("text_key"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, matched_windows, covered_tokens and item_tokens of every document and item of which it holds ``coverage``."""
    keyed = docs.select(_doc_key(False).alias("doc_id"), "text")
    return _leaks(keyed, benchmark.filter("item_id IS NOT NULL"), width, coverage).withColumn("doc_id", F.col("doc_id.doc_id"))


def _leaks(docs: DataFrame, benchmark: DataFrame, width: int, coverage: float) -> DataFrame:
    """``find_leaks`` of documents by ``_doc_key``; no item_id is null."""
    items = benchmark.select("item_id", "text").dropDuplicates(["item_id", "text"])
    hashed = materialize(_item_templates(items), "items")
    short = F.least(F.size("hashes"), F.lit(width)).alias("width")
    widths = sorted({width} | {r["width"] for r in hashed.select(short).filter("width > 0").distinct().collect()})  # at most ``width`` numbers
    theirs = None
    for w in widths:
        some = hashed.filter(short == w)
        for open_, column in ((False, "hashes"), (True, "supposed")):
            held = F.slice(column, F.col("position") + 1, w)
            own = windows(some.withColumn("row", F.struct("item_id", "hashes", "supposed")), "row", w, hashes=column).select("row.*", "position", "hash")
            own = own.filter(held != F.slice("hashes", F.col("position") + 1, w)) if open_ else own
            part = own.select("item_id", F.col("position").alias("item_position"), "hash", F.lit(open_).alias("open"), F.lit(w).alias("width"), F.exists(held, _is_slot).alias("slotted")).distinct()
            theirs = part if theirs is None else theirs.unionByName(part)
    theirs = materialize(theirs, "windows")
    small = theirs.count() <= BROADCAST_WINDOWS
    ours = windows(templates(docs, "doc_id"), "doc_id", *widths)
    columns = ["item_id", (F.col("position") - F.col("item_position")).alias("shift"), "item_position", "open", "width", "slotted"]
    found = ours.join(F.broadcast(theirs) if small else theirs, "hash").select(F.col("doc_id").alias("doc"), *columns).distinct()
    found = materialize(found, "matches")
    slotted = found.filter("slotted")
    if not slotted.isEmpty():
        bad = materialize(_inconsistent(slotted, docs, items), "inconsistent").select(F.col("doc").alias("b"), F.col("item_id").alias("bi"), F.col("shift").alias("bs"), F.col("open").alias("bo"), "clash", "changed")
        same = (F.col("doc") == F.col("b")) & (F.col("item_id") == F.col("bi")) & (F.col("shift") == F.col("bs")) & (F.col("open") == F.col("bo"))
        found = found.join(bad, same, "left")
        inside = lambda places: F.exists(places, lambda x: (x >= F.col("item_position")) & (x < F.col("item_position") + F.col("width")))
        found = found.filter(F.col("clash").isNull() | ~(inside("clash") & inside("changed")))
    held = found.groupBy("doc", "item_id").agg(F.collect_set(F.struct("item_position", "width")).alias("at"))  # at most an item's windows
    tokens = F.flatten(F.transform("at", lambda w: F.sequence(w["item_position"], w["item_position"] + w["width"] - 1)))
    sizes = hashed.groupBy("item_id").agg(F.max(F.size("hashes")).alias("item_tokens"))
    scored = held.select("doc", "item_id", F.size("at").alias("matched_windows"), F.size(F.array_distinct(tokens)).alias("covered_tokens")).join(sizes, "item_id")
    return scored.filter(F.col("covered_tokens") >= coverage * F.col("item_tokens")).select(F.col("doc").alias("doc_id"), "item_id", "matched_windows", "covered_tokens", "item_tokens")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows that hold no item."""
    item_key = F.when(F.col("item_id").isNotNull(), F.concat(F.lit("i"), F.col("item_id").cast("string"))).otherwise(F.concat(F.lit("t"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    keyed = docs.select(_doc_key(True).alias("doc_id"), "text")
    leaks = materialize(_leaks(keyed, benchmark.select(item_key.alias("item_id"), "text"), width, coverage).select(F.col("doc_id").alias("leaked")).distinct(), "leaks")
    if leaks.count() <= BROADCAST_DOCS:
        leaks = F.broadcast(leaks)
    rows = docs.select(_doc_key(True).alias("doc"), F.struct("*").alias("row"))
    return rows.join(leaks, F.col("doc") == F.col("leaked"), "left_anti").select("row.*")
