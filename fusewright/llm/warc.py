"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Writing: payload digests are grouped by partial aggregation; the smallest page_id of a
group becomes a ``response`` and the others ``revisit`` records that name it. Every task
writes files of its own, one gzip member per record, and reports them; the report,
committed by Spark, is the archive's manifest, so files of lost or repeated attempts are
never read. It holds where every record starts; a range in which the reader finds another number of records is an error.

Reading: the manifest's files are split into byte ranges. A task scans its range for the
gzip magic, accepts a candidate only if it decodes to a WARC header and, in the end, to the length
and checksum in its trailer, and owns the records that start inside its range, reading past the range's
end where the last one goes on. Nothing but the file's bytes is needed to begin anywhere.

Files are opened with ``pyarrow.fs``, so the folder may be any store that it knows.

Defined results: a null html is an empty payload; a null page_id or url is written as an absent
header and read as null; a url with line breaks is kept whole in a header of its own; rows that repeat a page_id and payload are one response and
revisits of themselves; a payload none of whose rows has a page_id is a response each time, as none can be named; very long pages are read whole; empty tables make empty
archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusewright.functions.storage import materialize
from fusewright.llm.common import ship, utf8

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20
ROLL_BYTES = 256 << 20
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, content binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{url}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\r\n]", "", url)),
        ("WARC-Page-URL", json.dumps(url) if url is not None and re.search(r"[\r\n]", url) else None),  # whole, if it holds line breaks
        ("WARC-Page-ID", page_id),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Payload-Length", len(payload)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("WARC-Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def record_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, record_type and refers_to of each row.

    Of the rows with one payload of ``least`` bytes or more, one of those with the smallest page_id is the response.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("size"))
    per_page = rows.filter(F.col("size") >= least).groupBy("sha1", "size", "page_id").agg(F.count("*").alias("n"))
    groups = per_page.groupBy(F.col("sha1").alias("g_sha1"), F.col("size").alias("g_size")).agg(F.min("page_id").alias("first"), F.min_by("n", "page_id").alias("n_first"), F.sum("n").alias("n"))
    # only groups of two or more, written first: a hot group's side of the join can then be split at run time
    shared = materialize(groups.filter("n > 1"), "payloads")
    joined = rows.join(shared, (F.col("sha1") == F.col("g_sha1")) & (F.col("size") == F.col("g_size")), "left")
    revisit = F.col("g_sha1").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    if not shared.filter("n_first > 1").isEmpty():
        # rows that repeat the smallest page_id: all but the first by url revisit it
        repeats = (F.col("page_id") == F.col("first")) & (F.col("n_first") > 1)
        order = F.row_number().over(Window.partitionBy("sha1", "size").orderBy("url"))
        ranked = joined.filter(repeats).withColumn("rank", order)
        joined = joined.filter(~F.coalesce(repeats, F.lit(False))).withColumn("rank", F.lit(1)).unionByName(ranked)
        revisit = revisit | (F.col("rank") > 1)
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_archives(typed: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write rows of ``record_types`` below ``folder``; returns the manifest (path, bytes, records, starts)."""
    spark = typed.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        store.create_dir(top, recursive=True)
        done: list[tuple[str, int, int, list[int]]] = []
        out, name, size, starts = None, "", 0, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("record_type", "page_id", "url", "refers_to")]
            for kind, page_id, url, refers_to, payload in zip(*columns, utf8(batch.column("html"))):
                if out is None:
                    name, size, starts = f"{uuid.uuid4().hex}.warc.gz", 0, []  # a name for this attempt alone
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                record = member(kind, page_id, url, payload, refers_to)
                out.write(record)
                starts.append(size)
                size += len(record)
                if size >= roll_bytes:
                    out.close()
                    done.append((name, size, len(starts), starts))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, len(starts), starts))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["name", "bytes", "records", "starts"])

    written = typed.mapInArrow(run, "name string, bytes long, records long, starts array<long>")
    return materialize(written.select(F.concat(F.lit(folder + "/"), "name").alias("path"), "bytes", "records", "starts"), "manifest")


class _Source:
    """Reads a file forward from any byte, in blocks."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size = file, size
        self.at, self.block = 0, b""

    def read(self, at: int) -> bytes:
        """Bytes from ``at`` on, at least 16 unless the file ends there; of a block that is kept."""
        if not self.at <= at <= self.at + len(self.block) - 16 or not self.block:
            self.at, self.block = at, self.file.read_at(min(READ_BYTES, self.size - at), at) if at < self.size else b""
        return self.block[at - self.at :]


def _decode(source: _Source, at: int) -> tuple[bytes, int] | None:
    """A member's content and end, or None where no WARC record starts; checks the header first, the trailer last."""
    unpack = zlib.decompressobj(31)
    parts: list[bytes] = []
    start, checked = at, False
    try:
        while not unpack.eof:
            data = source.read(at)
            if not data:
                return None
            got = unpack.decompress(data)
            at += len(data) - len(unpack.unused_data)
            parts.append(got)
            if not checked and (len(got) >= 10 or unpack.eof or sum(map(len, parts)) >= 10):
                if not _VERSION.match(b"".join(parts)):
                    return None
                checked = True
    except zlib.error:
        return None
    return (b"".join(parts), at) if checked and at > start else None


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (lower-case names) and block of a record, or None if its lengths disagree."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = raw[:end]
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    block = raw[len(head) + 4 :]
    length = fields.get("content-length", "")
    if not length.isdigit() or len(block) != int(length) + 4 or block[-4:] != b"\r\n\r\n":
        return None
    return fields, block[:-4]


def scan_range(file: pa.NativeFile, size: int, first: int, last: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in [first, last)."""
    source, at = _Source(file, size), first
    while at < last:
        data = source.read(at)
        if not data:
            return
        k = data.find(MAGIC)
        if k < 0:
            at += max(1, len(data) - 2)
            continue
        at += k
        if at >= last:
            return
        got = _decode(source, at)
        record = parse_record(got[0]) if got else None
        if record is None:
            at += 1
            continue
        yield at, *record
        at = got[1]


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of a manifest's files: ``RECORDS``; content is null for revisits. Digests are recomputed from stored payloads."""
    ship(manifest.sparkSession)
    firsts = F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")
    ranges = manifest.filter("bytes > 0 OR records > 0").select("path", "bytes", "records", "starts", F.explode(firsts).alias("first"))
    inside = F.filter("starts", lambda s: (s >= F.col("first")) & (s < F.col("first") + split_bytes))
    ranges = ranges.select("path", "bytes", "first", F.size(inside).cast("long").alias("expected"), (F.size("starts") == F.col("records")).alias("whole"))
    parts = max(1, ranges.count())
    ranges = ranges.repartition(min(parts, 100_000), F.xxhash64("path", "first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        held = 0
        number = lambda v: None if v is None else int(v)
        for batch in batches:
            for path, size, first, expected, whole in zip(*[batch.column(c).to_pylist() for c in ("path", "bytes", "first", "expected", "whole")]):
                if not whole:
                    raise ValueError(f"{path}: the manifest's count of records is not that of their starts")
                found = 0
                store, name = _open(path)
                with store.open_input_file(name) as file:
                    for _, head, block in scan_range(file, size, first, min(size, first + split_bytes)):
                        found += 1
                        kind = head.get("warc-type")
                        body = _payload(block) if kind == "response" else None
                        stored = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        if body is not None and digest(body) != stored:
                            raise ValueError(f"{path}: the payload of page {head.get('warc-page-id')} does not match its digest")
                        length = len(body) if body is not None else int(head["warc-payload-length"])
                        url = json.loads(head["warc-page-url"]) if "warc-page-url" in head else head.get("warc-target-uri")
                        rows.append((number(head.get("warc-page-id")), url, length, stored, kind, number(head.get("warc-refers-to-page-id")), body))
                        held += len(body or b"") + 100
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if found != expected:
                    raise ValueError(f"{path}: {found} records start in the range from byte {first}, but {expected} in the manifest")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return ranges.mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, folder: str, least: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write the pages below ``folder`` and read the archives back."""
    return read_archives(write_archives(record_types(pages, least), folder), split_bytes)
