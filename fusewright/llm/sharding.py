"""Fixed virtual slots with a versioned slot-to-shard map.

Records hash into ``N_SLOTS`` slots by doc_id and text; bytes are summed per slot; the map from
slot to shard is a small table of versions in the shared folder. Version 1 deals slots out in turn, without a look at the data; rebalancing edits the
map by the bytes that slots hold and stores the edit as a new version, so it moves whole slots and no other record. Records are placed
by the version read back.

A slot of over ``SPLIT`` times the mean bytes or rows, as rows that repeat in all columns make it, is divided into parts with entries of their own, so that neither
a shard nor a task gets more than its share. The map has at most (1 + 2 / ``SPLIT``) * ``N_SLOTS`` entries whatever the input, which is what lets the driver edit it.

Defined results: a null text has size 1 (no bytes plus one) and the CRC of nothing; a
null doc_id hashes like any value; rows that repeat doc_id and text share a slot, and its parts if it is divided; very long texts count whole; empty
tables give an empty result and a map of empty slots; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fusewright.functions.storage import exists, materialize, scratch

N_SLOTS, SPLIT = 8192, 4
TOLERANCE = 0.001
MAP_SCHEMA = "version int, virtual_slot int, part int, shard int, bytes long"
Slot = tuple[int, int]  # virtual slot and part


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each row; texts stay where they are."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_slots)).cast("int")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), slot.alias("virtual_slot"))


def with_parts(slotted: DataFrame, n_slots: int, split: float = SPLIT) -> DataFrame:
    """Adds part, 0 where a slot is whole; ``slotted`` is a stored table with row, a number of each row."""
    held = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    totals = held.agg(F.sum("bytes").alias("all_bytes"), F.sum("n").alias("all_n"))
    share = lambda c: F.ceil(F.col(c) * F.lit(n_slots / split) / F.col(f"all_{c}"))
    parts = held.crossJoin(F.broadcast(totals)).select("virtual_slot", F.least(F.greatest(share("bytes"), share("n")), "n").alias("parts"))  # one row; n_slots rows
    parts = materialize(parts.filter("parts > 1"), "parts")
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int")
    return slotted.join(F.broadcast(parts), "virtual_slot", "left").withColumn("part", part).drop("parts")  # n_slots / 2 rows


def assign(sizes: dict[Slot, int], n_shards: int, slots: list[Slot]) -> dict[Slot, int]:
    """Largest slot first, each to the lightest shard, ties to the lowest number."""
    loads = [(0, s) for s in range(n_shards)]
    shards = {}
    for slot in sorted(slots, key=lambda s: (-sizes.get(s, 0), s)):
        load, shard = heapq.heappop(loads)
        shards[slot] = shard
        heapq.heappush(loads, (load + sizes.get(slot, 0), shard))
    return shards


def rebalance(shards: dict[Slot, int], sizes: dict[Slot, int], n_shards: int, tolerance: float = TOLERANCE) -> dict[Slot, int]:
    """An edited map: slots leave the heaviest shard for the lightest until they differ by ``tolerance`` of the mean, or no move mends more.

    Also grows or shrinks: shards from ``n_shards`` on are emptied first, and new shards start empty.
    """
    new = dict(shards)
    loads = dict.fromkeys(range(n_shards), 0)
    held: dict[int, list[tuple[int, Slot]]] = {s: [] for s in range(n_shards)}
    homeless = []
    for slot, shard in sorted(new.items()):
        if shard < n_shards:
            loads[shard] += sizes.get(slot, 0)
            held[shard].append((sizes.get(slot, 0), slot))
        else:
            homeless.append((sizes.get(slot, 0), slot))
    for size, slot in sorted(homeless, reverse=True):
        to = min(loads, key=lambda s: (loads[s], s))
        new[slot] = to
        loads[to] += size
        held[to].append((size, slot))
    allowed = tolerance * sum(loads.values()) / n_shards
    into = [s for s in range(n_shards) if not held[s]] or list(loads)  # with empty shards, nothing moves but into them
    for _ in range(4 * len(new)):
        high = max(loads, key=lambda s: (loads[s], -s))
        low = min(into, key=lambda s: (loads[s], s))
        gap = loads[high] - loads[low]
        movable = [x for x in held[high] if 0 < x[0] < gap]
        if gap <= allowed or not movable:
            break
        pick = min(movable, key=lambda x: (abs(gap / 2 - x[0]), x[1]))
        held[high].remove(pick)
        held[low].append(pick)
        new[pick[1]] = low
        loads[high] -= pick[0]
        loads[low] += pick[0]
    return new


def map_version(spark: SparkSession, shards: dict[Slot, int], sizes: dict[Slot, int], version: int) -> DataFrame:
    """One version of the map as a table."""
    return spark.createDataFrame([(version, *k, v, sizes.get(k, 0)) for k, v in sorted(shards.items())], MAP_SCHEMA)


def save_map(versions: DataFrame, path: str) -> None:
    """Append versions to the map's table; a version is never rewritten."""
    versions.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest one if none is named."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    at = stored.agg(F.max("version")).head()[0] if version is None else version
    return stored.filter(F.col("version") == at)


def edit_map(spark: SparkSession, path: str, sizes: dict[Slot, int], n_shards: int, n_slots: int) -> int:
    """The version to place by: the latest stored one (a new map is dealt out in turn), or a new one if the sizes unbalance it."""
    if not exists(spark, path):
        save_map(map_version(spark, {(s, 0): s % n_shards for s in range(n_slots)}, {}, 1), path)
    stored = load_map(spark, path).collect()  # a map's entries
    old = {(r["virtual_slot"], r["part"]): r["shard"] for r in stored}
    version = stored[0]["version"]
    known = {k: old.get(k, k[0] % n_shards) for k in {*old, *sizes}}
    edited = rebalance(known, sizes, n_shards)
    if edited == old:
        return version
    save_map(map_version(spark, edited, sizes, version + 1), path)
    return version + 1


def place(parted: DataFrame, slot_map: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds shard, and slot: the record's place in its shard, gapless from 0.

    Places come from a prefix sum over the entries of a shard (a map's entries) plus a rank within the entry.
    """
    w = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(F.broadcast(counts), ["virtual_slot", "part"], "left").select("virtual_slot", "part", "shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    placed = parted.withColumn("rank", rank).join(F.broadcast(starts), ["virtual_slot", "part"])
    return placed.withColumn("slot", (F.col("first") + F.col("rank")).cast("long")).drop("rank", "first", "row")


def shard_documents(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, map_path: str | None = None, split: float = SPLIT) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, part, shard, slot and map_version of each row.

    The map stored at ``map_path`` (none: a new one in the shared folder) is edited if the sizes unbalance it, and read back.
    """
    spark = docs.sparkSession
    map_path = map_path or scratch(spark, "slot-map")
    slotted = materialize(with_slots(docs, n_slots).withColumn("row", F.monotonically_increasing_id()), "slots")
    parted = with_parts(slotted, n_slots, split)
    counts = materialize(parted.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "counts")
    sizes = {(r["virtual_slot"], r["part"]): r["bytes"] for r in counts.collect()}  # a map's entries
    version = edit_map(spark, map_path, sizes, n_shards, n_slots)
    slot_map = load_map(spark, map_path, version)
    return place(parted, slot_map, counts.select("virtual_slot", "part", "n")).withColumn("map_version", F.lit(version))
