"""Near-duplicate classes from min-wise bands: signatures, candidate pairs, exact verification.

Signatures are one-permutation min-wise hashes: each shingle falls into one of ``BINS`` bins, a bin
keeps its least value, and an empty bin borrows from a bin that its own fixed probe order finds
full. ``BANDS`` bands of ``ROWS`` bins each make the keys: at a similarity of 0.8, 99.8 % of
pairs share one.

Texts that share a key form a group. First every text is compared with the least of its group, which joins
most that belong together. Then only groups that hold several components are open, and all members
outside a group's largest component are compared with all others, by sketches: the parity of a text's shingles in ``SKETCH`` bits.
Two parities differ in no more bits than the shingle sets have elements apart, so pairs too far apart are told in a few words
and none that is similar is lost. Large groups compare sketches bit-sliced: bit planes stored vertically, many distances advanced
at once in carry-save counters, blocks abandoned once all are past the radius. Of what remains, each member's closest pairs are verified
exactly; a turn takes ``GROWTH`` times as many to a member as the one before, until no group is open.

Skew: keys that a slice of the input holds ``LOCAL`` times or more are grouped there and travel as one member, the others of
the slice going to any task; groups over ``CHUNK`` members are dealt as pairs of chunks. No task holds a hot key.

Keys travel as blocks of many, by bucket, which costs the shuffle far less than a row for each. Bodies are fetched by a second scan
behind a Bloom filter of the candidates' ids, of ``FILTER_BITS`` bits at most and left out where they would fill it, and joined with the ids by a shuffle.
Ids are 64-bit hashes; a second hash, ``check``, tells the body that was compared from others of the same id, which join no class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize, scope
from fusewright.llm.common import ByteCache, map_batches, ship
from fusewright.operators.components import component_stars

BANDS, ROWS = 16, 5
BINS = BANDS * ROWS
SKETCH, CHUNK = 2048, 16_384
#: Input bytes of a bucket of keys: there are so many buckets that none is larger, whatever the number of shuffle partitions.
LOCAL, BUCKET_BYTES, MAX_BUCKETS = 16, 1 << 20, 1 << 24
#: Closest pairs that a member has verified in the first turn, and the factor from turn to turn.
PER_MEMBER, GROWTH = 4, 4
#: Members from which a group is compared bit-sliced; numpy's calls cost more than the work below. Queries at a time, planes between tests for abandonment.
SLICED, QUERIES, TESTED = 1024, 64, 128
#: Groups of so many are compared together, so many pairs at a time.
SMALL, LANES = 128, 1 << 14
SKETCHED = 256
FILTER_BITS = 1 << 28
#: Bytes of the texts, and of what is made of them, that a task keeps while it verifies pairs.
CACHED_TEXTS = 64 << 20
_EMPTY = np.uint32(0xFFFFFFFF)
_PROBES = np.random.RandomState(7).randint(0, BINS, (64, BINS))  # noqa: NPY002  fixed probe order


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def mix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def band_keys(hashes: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """(owners, BANDS) keys as int64 from mixed 32-bit shingle hashes and the owner of each; every owner has a shingle."""
    bins = ((hashes >> np.uint32(16)) * np.uint32(BINS)) >> np.uint32(16)
    sig = np.full(owners * BINS, _EMPTY)
    np.minimum.at(sig, owner * BINS + bins, hashes * np.uint32(0x9E3779B1))
    sig = sig.reshape(owners, BINS)
    full = sig != _EMPTY
    row, col = np.nonzero(~full)
    for t, probe in enumerate(_PROBES):
        if not len(row):
            break
        source = probe[col]
        hit = full[row, source]
        sig[row[hit], col[hit]] = sig[row[hit], source[hit]] + np.uint32((t + 1) * 0x632BE5AB & 0xFFFFFFFF)
        row, col = row[~hit], col[~hit]
    if len(row):  # few full bins: the next full one in circular order
        order = (col[:, None] + np.arange(1, BINS)) % BINS
        step = full[row[:, None], order].argmax(1)
        sig[row, col] = sig[row, order[np.arange(len(row)), step]] + np.uint32(99)
    keys = np.zeros((owners, BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + sig[:, r * BANDS : (r + 1) * BANDS] + np.uint64(r))
    return mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


Body = str | bytes
Alike = Callable[[Body, Body, int, int, ByteCache], bool]


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def n_buckets(df: DataFrame) -> int:
    """For the keys of ``df``: by the bytes that its plan reads, and several for each task."""
    read = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-read // BUCKET_BYTES)), MAX_BUCKETS)


def key_blocks(keys: np.ndarray, ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, grouped, block). keys: (texts, BANDS); ids: of the texts.

    Blocks hold the (key, id) of one bucket; grouped ones the (key, id, least id) of a key that the texts hold ``LOCAL`` times or more, of which only the
    least id is in the bucket of the key.
    """
    key, id_ = keys.ravel().view(np.uint64), np.repeat(ids, keys.shape[1])
    order = np.argsort(key)
    key, id_ = key[order], id_[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    stays = np.ones(len(key), bool)
    rows: list[tuple[int, bool, bytes]] = []
    for s, n in zip(starts[sizes >= LOCAL].tolist(), sizes[sizes >= LOCAL].tolist()):
        members = id_[s : s + n]
        at = s + int(members.argmin())
        stays[s : s + n] = False
        stays[at] = True
        rows.append((int(mix(key[s] ^ members[:1].view(np.uint64))[0] % np.uint64(buckets)), True, np.stack((key[s : s + n].view(np.int64), members, np.full(n, id_[at]))).tobytes()))
    key, id_ = key[stays], id_[stays]
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # rises with the key
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for s, e in zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist()):
        rows.append((int(bucket[s]), False, np.stack((key[s:e].view(np.int64), id_[s:e])).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary()))], ["bucket", "grouped", "block"])


BLOCKS = "bucket int, grouped boolean, block binary"


def sorted_set(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; by sorting, which for short arrays is far faster than ``np.unique``'s table."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def sketches(hashes: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct hashes, and (owners, SKETCH / 64) words of parities."""
    distinct = sorted_set(owner.astype(np.uint64) << np.uint64(32) | hashes)
    who, h = (distinct >> np.uint64(32)).astype(np.int64), distinct & np.uint64(0xFFFFFFFF)
    parity = np.zeros(owners * SKETCH, np.uint8)
    np.bitwise_xor.at(parity, who * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64), np.uint8(1))
    return np.bincount(who, minlength=owners), np.packbits(parity, bitorder="little").view(np.uint64).reshape(owners, -1)


def _starred(blocks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``_groups`` of the (key, id) of one bucket."""
    cols = np.concatenate(blocks, axis=1)
    order = np.argsort(cols[0])
    key = cols[0][order]
    same = key[1:] == key[:-1]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]  # most keys are alone
    if not len(order):
        return
    key, id_ = cols[0][order], cols[1][order]
    order = np.lexsort((id_, key))
    key, id_ = key[order], id_[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])))
    key, id_ = key[new], id_[new]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    least = np.repeat(starts, sizes)
    rest = np.flatnonzero(least != np.arange(len(key)))
    many = np.repeat(sizes > 2, sizes)
    if len(rest):
        yield _batch({"kind": np.zeros(len(rest), np.int32), "key": key[rest], "a": id_[rest], "b": id_[least[rest]]})
    if many.any():
        yield _batch({"kind": np.ones(many.sum(), np.int32), "key": key[many], "a": id_[many], "b": id_[many]})


def _groups(keys: DataFrame) -> DataFrame:
    """kind 0: pairs (a > b) of the least id known of a group with the others; kind 1: members (key, a) of groups of three or more, some repeatedly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for batch in batches:  # sorted, so a bucket's blocks come together
            for bucket, grouped, block in zip(*[batch.column(c).to_pylist() for c in ("bucket", "grouped", "block")]):
                if grouped:
                    key, id_, least = np.frombuffer(block, np.int64).reshape(3, -1)
                    rest = id_ != least
                    yield _batch({"kind": np.zeros(rest.sum(), np.int32), "key": key[rest], "a": id_[rest], "b": least[rest]})
                    yield _batch({"kind": np.ones(len(key), np.int32), "key": key, "a": id_, "b": id_})
                    continue
                if bucket != last and held:
                    yield from _starred(held)
                    held = []
                last = bucket
                held.append(np.frombuffer(block, np.int64).reshape(2, -1))
        if held:
            yield from _starred(held)

    ship(keys.sparkSession)
    return keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "kind int, key long, a long, b long")


def _too_far(n: np.ndarray, similarity: float) -> np.ndarray:
    """The number of differing bits from which sets of ``n`` elements together cannot be similar; with some room for hashes that meet."""
    return np.floor(n * ((1 - similarity) / (1 + similarity))) + 4


def _near_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches allow the similarity."""
    end = lambda c, n: texts.select(F.col("id").alias(c), F.col("n").alias(f"n{n}"), F.col("bits").alias(f"b{n}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("b1", "b2"))
                n = batch.column("n1").to_numpy() + batch.column("n2").to_numpy()
                ok = np.bitwise_count(x ^ y).sum(1) <= _too_far(n, similarity)
                if ok.any():
                    yield _batch({c: batch.column(c).to_numpy()[ok] for c in ("a", "b")})

    return pairs.join(end("a", 1), "a").join(end("b", 2), "b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, alike: Alike) -> DataFrame:
    """(a, b, ok): whether the pairs' texts are alike."""
    end = lambda c, x: texts.select(F.col("id").alias(c), F.col("body").alias(x), F.col("n").alias(f"n_{x}"))
    both = pairs.join(end("a", "x"), "a").join(end("b", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ByteCache(CACHED_TEXTS)
        for batch in batches:
            ends = zip(*[batch.column(c) for c in ("x", "y")], *[batch.column(c).to_pylist() for c in ("n_x", "n_y")])
            ok = np.fromiter((alike(x.as_py(), y.as_py(), n, m, cache) for x, y, n, m in ends), bool, batch.num_rows)
            yield _batch({"a": batch.column("a").to_numpy(), "b": batch.column("b").to_numpy(), "ok": ok})

    return materialize(both.select("a", "b", "x", "y", "n_x", "n_y").mapInArrow(run, "a long, b long, ok boolean"), "links")


def common_ends(x: Body, y: Body) -> tuple[int, int]:
    """Lengths of the common beginning and of the common end after it, by halving."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
    start, low, high = low, 0, min(len(x), len(y)) - low
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[len(x) - mid : len(x) - low] == y[len(y) - mid : len(y) - low] else (low, mid - 1)
    return start, low


def surely_alike(n: int, m: int, left: int, right: int, similarity: float) -> bool:
    """Whether sets of at least ``n`` and ``m`` elements, of which at most ``left`` and ``right`` are not in the other, are similar whatever they hold."""
    both = max(n - left, m - right)
    return both >= similarity * (both + left + right)


def cached(cache: ByteCache | dict, text: Body, make: Callable[[Body], object]) -> object:
    """``make(text)``, kept for the texts seen lately, or for all in a plain dict; ``nbytes`` of what is made tells its size."""
    found = cache.get(text)
    if found is None:
        found = make(text)
        if isinstance(cache, ByteCache):
            cache.keep(text, found, found.nbytes, renew=True)
        else:
            cache[text] = found
    return found


def _planes(bits: np.ndarray) -> np.ndarray:
    """(SKETCH, words): lane k of row b is bit b of sketch k."""
    lanes = np.zeros((-(-len(bits) // 64) * 64, bits.shape[1]), np.uint64)
    lanes[: len(bits)] = bits
    out = np.empty((SKETCH, len(lanes) // 64), np.uint64)
    for k in range(0, len(lanes), 4096):
        part = np.unpackbits(lanes[k : k + 4096].view(np.uint8), axis=1, bitorder="little")
        out[:, k // 64 : (k + 4096) // 64] = np.packbits(np.ascontiguousarray(part.T), axis=1, bitorder="little").view(np.uint64)
    return out


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder: sum and carry of three bits in every lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def sliced_distances(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray | None:
    """(queries, lanes) distances of sketches to the lanes of bit planes; None once all are past the radius."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    masks = np.where(np.unpackbits(queries.view(np.uint8), axis=1, bitorder="little").T, full, np.uint64(0))
    shape = (len(queries), planes.shape[1])
    low = [np.zeros(shape, np.uint64) for _ in range(4)]  # ones, twos, fours, eights
    high = [np.zeros(shape, np.uint64) for _ in range((SKETCH // 16).bit_length())]  # sixteens and above
    for first in range(0, SKETCH, 16):
        row = [planes[b][None, :] ^ masks[b][:, None] for b in range(first, first + 16)]
        for k in range(4):
            carries = []
            for x, y in zip(row[::2], row[1::2]):
                low[k], c = _add(low[k], x, y)
                carries.append(c)
            row = carries
        carry = row[0]
        for c in high:
            carry, c[...] = c & carry, c ^ carry
        if (first + 16) % TESTED == 0:
            within, equal = np.zeros(shape, np.uint64), np.full(shape, full)
            for k in reversed(range(len(high))):  # compared with radius // 16, from the highest counter down
                if radius // 16 >> k & 1:
                    within |= equal & ~high[k]
                    equal &= high[k]
                else:
                    equal &= ~high[k]
            if not (within | equal).any():
                return None
    out = np.zeros((len(queries), planes.shape[1] * 64), np.int16)
    for k, c in enumerate(low + high):
        out += np.unpackbits(c.view(np.uint8), axis=1, bitorder="little").astype(np.int16) << k
    return out


def _distances(left: np.ndarray, right: np.ndarray, radii: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances of some rows of ``left`` to all of ``right``), without rows of which all are past their radius (of ``left``'s rows, at most)."""
    if len(right) < SLICED:
        rows = max(1, (1 << 20) // (len(right) * right.shape[1]))
        for k in range(0, len(left), rows):
            yield k, np.bitwise_count(left[k : k + rows, None, :] ^ right[None, :, :]).sum(2, dtype=np.int32)
        return
    planes = _planes(right)
    for k in range(0, len(left), QUERIES):
        found = sliced_distances(planes, left[k : k + QUERIES], int(radii[k : k + QUERIES].max()))
        if found is not None:
            yield k, found[:, : len(right)]


Side = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _closest(owner: np.ndarray, apart: np.ndarray, other: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ``most`` pairs of least (apart, other) of every owner, and the owners that have more."""
    order = np.lexsort((other, apart, owner))
    who = owner[order]
    first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(who)))
    near = np.arange(len(who)) - np.repeat(first, sizes) < most
    return order[near], who[first[sizes > most]]


def closest_links(left: Side, right: Side | None, most: int, similarity: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (a > b) between components whose sketches allow the similarity: of each of ``left`` the ``most`` closest of ``right`` (none: of those
    before it in ``left``), and whether some were left out. A side: ids, roots, sizes and bits."""
    id_, root, size, bits = left
    other = left if right is None else right
    a, b, more = [], [], False
    for k, apart in _distances(bits, other[3], _too_far(size + other[2].max(), similarity)):
        rows = slice(k, k + len(apart))
        ok = (apart <= _too_far(size[rows, None] + other[2][None, :], similarity)) & (root[rows, None] != other[1][None, :])
        if right is None:
            ok &= np.arange(len(id_))[None, :] < np.arange(k, k + len(apart))[:, None]
        i, j = np.nonzero(ok)
        near, cut = _closest(i, apart[i, j], other[0][j], most)
        more |= len(cut) > 0
        x, y = id_[rows][i[near]], other[0][j[near]]
        a.append(np.maximum(x, y))
        b.append(np.minimum(x, y))
    none = np.empty(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none]), more


def small_links(starts: np.ndarray, sizes: np.ndarray, side: Side, most: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many small groups at once, runs of ``side`` sorted by id; the third are places in groups of which some were left out."""
    id_, root, size, bits = side
    left, right, none = [], [], np.empty(0, np.int64)
    for n in np.unique(sizes):
        j, i = np.triu_indices(n, 1)
        at = starts[sizes == n]
        step = max(1, LANES // max(1, len(i)))
        for k in range(0, len(at), step):
            x, y = ((at[k : k + step, None] + c).ravel() for c in (i, j))
            apart = root[x] != root[y]
            left.append(x[apart])
            right.append(y[apart])
    i, j = np.concatenate(left or [none]), np.concatenate(right or [none])
    far = [np.bitwise_count(bits[i[k : k + LANES]] ^ bits[j[k : k + LANES]]).sum(1, dtype=np.int32) for k in range(0, len(i), LANES)]
    apart = np.concatenate(far or [none])
    ok = apart <= _too_far(size[i] + size[j], similarity)
    i, j, apart = i[ok], j[ok], apart[ok]
    near, cut = _closest(i, apart, id_[j], most)
    x, y = id_[i[near]], id_[j[near]]
    return np.maximum(x, y), np.minimum(x, y), cut


def _open_links(members: DataFrame, stars: DataFrame, texts: DataFrame, most: int, similarity: float) -> DataFrame:
    """Pairs (a, b) between the components of the groups that are open, the ``most`` closest to a member; ``key`` without a pair names a group that has more."""
    labels = stars.select(F.col("u").alias("id"), F.col("v").alias("root"))
    rooted = materialize(members.join(labels, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "members")
    counts = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    several = counts.groupBy("key").agg(F.max_by("root", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("roots")).filter("roots > 1")
    chunks = lambda n: F.ceil(n / CHUNK).cast("int")
    several = materialize(several.select("key", "main", chunks(F.col("total") - F.col("most")).alias("minor"), chunks(F.col("most")).alias("major"), (F.col("total") <= SMALL).alias("small")), "open")
    there = rooted.join(several, "key").join(texts.select("id", "n", "bits"), "id")
    # chunks outside the largest component, then those of it; the former meet all, the latter only the former. Small groups are one chunk
    inner = F.col("root") == F.col("main")
    own = F.when(inner, F.col("minor") + F.pmod(F.xxhash64("id"), F.col("major"))).otherwise(F.pmod(F.xxhash64("id"), F.col("minor"))).cast("int")
    others = F.sequence(F.lit(0), F.when(inner, F.col("minor") - 1).otherwise(F.col("minor") + F.col("major") - 1))
    one = F.array(F.lit(0))
    dealt = there.withColumn("own", F.when(F.col("small"), 0).otherwise(own)).withColumn("other", F.explode(F.when(F.col("small"), one).otherwise(others)))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "root", "n", "bits")
    names = ("key", "low", "high")

    def answer(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """Pairs, and the keys of groups that have more."""
        none = [None] * len(key)
        return pa.RecordBatch.from_arrays([pa.array([*none, *a.tolist()], pa.int64()), pa.array([*none, *b.tolist()], pa.int64()), pa.array([*key.tolist(), *[None] * len(a)], pa.int64())], ["a", "b", "key"])

    def solve(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Whole groups, in order."""
        col = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        order = np.lexsort((col["id"], col["high"], col["low"], col["key"]))
        new = np.concatenate(([True], np.any([col[c][order][1:] != col[c][order][:-1] for c in (*names, "id")], axis=0)))
        col = {c: x[order[new]] for c, x in col.items()}
        starts = np.flatnonzero(np.concatenate(([True], np.any([col[c][1:] != col[c][:-1] for c in names], axis=0))))
        sizes = np.diff(np.append(starts, len(col["key"])))
        side = tuple(col[c] for c in ("id", "root", "n", "bits"))
        small = sizes <= SMALL
        if small.any():
            # chunks of large groups that are small themselves meet by the rules of their sides
            whole = small & (col["low"][starts] == col["high"][starts])
            a, b, cut = small_links(starts[whole], sizes[whole], side, most, similarity)
            yield answer(np.unique(col["key"][cut]), a, b)
            small = whole
        for s, e in zip(starts[~small].tolist(), (starts + sizes)[~small].tolist()):
            sides = [tuple(x[s:e][col["own"][s:e] == chunk] for x in side) for chunk in dict.fromkeys((int(col["low"][s]), int(col["high"][s])))]
            if all(len(x[0]) for x in sides):
                a, b, more = closest_links(sides[0], sides[1] if len(sides) > 1 else None, most, similarity)
                yield answer(col["key"][s : s + more], a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []  # groups whose last may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            part = {c: batch.column(c).to_numpy() for c in (*names, "own", "id", "root", "n")}
            part["bits"] = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            last = np.flatnonzero(np.any([part[c] != part[c][-1] for c in names], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            goes_on = held and not cut and all(held[-1][c][-1] == part[c][0] for c in names)
            if held and not goes_on:
                held.append({c: x[:cut] for c, x in part.items()})
                yield from solve(held)
                held = []
            elif cut:
                yield from solve([{c: x[:cut] for c, x in part.items()}])
            held.append({c: x[cut:] for c, x in part.items()})
        if held:
            yield from solve(held)

    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long, key long").distinct()


def similar_stars(keys: DataFrame, fetch: Callable[[DataFrame], DataFrame], alike: Alike, similarity: float, linked: DataFrame | None = None) -> DataFrame:
    """(id, check, root): every text of a class of two or more near-duplicates, with the least id of the class.

    keys: ``key_blocks`` of (key, id); fetch: (id, check, body, n, bits) of the ids of a table; alike: (body, body, n, n, cache) to bool;
    linked: pairs (a > b) of ids found in another way, which are verified first; what they join is not compared by the keys again.
    """
    with scope(keys.sparkSession) as keep:
        return keep(_classes(keys, fetch, alike, similarity, linked))


def _classes(keys: DataFrame, fetch: Callable[[DataFrame], DataFrame], alike: Alike, similarity: float, linked: DataFrame | None) -> DataFrame:
    found = materialize(_groups(keys), "candidates")
    pairs = found.filter("kind = 0").select("a", "b").distinct()
    every = pairs if linked is None else pairs.unionByName(linked)
    texts = materialize(fetch(materialize(every.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")), "texts")
    verify = lambda some: _verified(materialize(_near_pairs(some, texts, similarity), "pairs"), texts, alike)
    if linked is None:
        checked = verify(pairs)
    else:
        first = verify(linked)
        joined = component_stars(first.filter("ok").select(F.col("a").alias("u"), F.col("b").alias("v")))
        for end in ("a", "b"):
            pairs = pairs.join(joined.select(F.col("u").alias(end), F.col("v").alias(f"root_{end}")), end, "left")
        apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
        checked = first.unionByName(verify(pairs.filter(apart).select("a", "b").join(first, ["a", "b"], "left_anti")))
    stars = component_stars(checked.filter("ok").select(F.col("a").alias("u"), F.col("b").alias("v")))
    members = found.filter("kind = 1").select("key", F.col("a").alias("id"))
    failed = checked.filter("NOT ok").select("a", "b")
    most = PER_MEMBER
    while True:
        links = materialize(_open_links(members, stars, texts, most, similarity), "links")
        checked = _verified(links.filter("a IS NOT NULL").select("a", "b").join(failed, ["a", "b"], "left_anti"), texts, alike)
        stars = component_stars(stars.unionByName(checked.filter("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))))
        # of other groups all pairs that the sketches allow are verified
        unfinished = links.filter("key IS NOT NULL").select("key").distinct()
        if unfinished.isEmpty():
            break
        failed = failed.unionByName(checked.filter("NOT ok").select("a", "b"))
        members = materialize(members.join(unfinished, "key", "left_semi"), "unfinished")
        most *= GROWTH
    ends = stars.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    return materialize(texts.select("id", "check").join(ends, "id"), "classes")


def id_filter(ids: DataFrame) -> Broadcast:
    """Two bits an id in ``FILTER_BITS`` bits at most, for ``may_hold``; empty, and holding all, where so many ids would fill it."""
    spark = ids.sparkSession
    n = ids.count()
    if 4 * n > FILTER_BITS:  # over a third of the bits would be set
        return spark.sparkContext.broadcast(b"")
    n_bits = min(max(1 << 15, 1 << (16 * n).bit_length()), FILTER_BITS)
    at = lambda shift: F.shiftrightunsigned("id", shift).bitwiseAND(n_bits - 1)
    places = ids.select(F.explode(F.array(at(0), at(32))).alias("at"))
    pages = places.groupBy(F.shiftright("at", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << 15) - 1)).alias("bits"))
    bits = bytearray(n_bits // 8)
    for r in pages.collect():  # FILTER_BITS in all
        bits[r["page"] << 12 : (r["page"] + 1) << 12] = r["bits"]
    return spark.sparkContext.broadcast(bytes(bits))


def may_hold(bits: bytes, ids: np.ndarray) -> np.ndarray:
    """Which of the ids (int64) the filter may hold: all that it does, and few others."""
    if not bits:
        return np.ones(len(ids), bool)
    bitmap = np.frombuffer(bits, np.uint8)
    mask = np.uint64(8 * len(bitmap) - 1)
    ok = np.ones(len(ids), bool)
    for shift in (0, 32):
        at = (ids.view(np.uint64) >> np.uint64(shift)) & mask
        ok &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def fetch_by_id(bodies: Callable[[Broadcast], DataFrame], ids: DataFrame) -> DataFrame:
    """One (id, check, body) for each of ``ids``; ``bodies`` scans the corpus for what a filter may hold."""
    return bodies(id_filter(ids)).join(ids.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"])


def with_sketches(texts: DataFrame, kind: str, shingle_sets: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds n and bits to (id, check, body); ``shingle_sets`` gives the 32-bit hashes of all bodies' shingles and the owner of each."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = batch.column("body").to_pylist()
        parts = [sketches(*shingle_sets(part), len(part)) for k in range(0, len(bodies), SKETCHED) if (part := bodies[k : k + SKETCHED])]
        n, bits = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "check", "body")], pa.array(n, pa.int64()), pa.array([x.tobytes() for x in bits], pa.binary())], ["id", "check", "body", "n", "bits"])

    return map_batches(texts, work, f"id long, check long, body {kind}, n long, bits binary")
