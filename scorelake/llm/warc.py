"""WARC archives: a writer with one gzip member a record, and a splittable reader.

Writing: records with equal payloads of at least ``least`` bytes are told apart by a grouped minimum of
page_id over the SHA-1 digest: the smallest page_id carries the payload (response), the others point to
it (revisit). Each task streams its records into files of about ``FILE_BYTES``, under a name of its own
attempt that is renamed when complete. Reading: a file is cut into byte ranges of ``SPLIT_BYTES``. A
task scans its range for the gzip magic, checks a candidate by decoding it up to a WARC version line
(compressed data may hold the magic by chance), reads members from there on, and owns exactly the
records that start inside its range, finishing the last one beyond it. Records of all types are returned
(warcinfo, request, metadata, ...): what is no HTTP message has its whole block as payload, and a header or digest that a
record does not state is null or taken as it is.

A null html is an empty payload. A null page_id is never smaller than another; if all are null, all
carry their payload. Rows that share the smallest page_id all carry it. Other columns are ignored and
an empty table gives no files and no rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import files
from scorelake.llm.common import frugal, pieces, rows

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 256 << 20
SPLIT_BYTES = 32 << 20
CHUNK = 1 << 20
STEP = 1 << 15  # compressed bytes inflated at a time
DATE = "2026-01-01T00:00:00Z"  # of every record, so that equal input gives equal files
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base32 of a SHA-1 in hex: five hex digits make four letters."""
    out = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_ALPHABET), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest and the response's page_id (null for responses) of every row."""
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    seen = seen.withColumn("digest", F.sha1("payload"))
    first = seen.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    joined = seen.join(first, "digest", "left").withColumn("digest", base32_of_hex(F.col("digest")))
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def _id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url or "about:blank")),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if refers_to is not None:
        head += [("WARC-Refers-To", _id(refers_to)), ("WARC-Profile", _PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _writes(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, part = files.Store(folder), TaskContext.get().partitionId()
        done: list[tuple[str, int, int]] = []
        sink, count, size = None, 0, 0

        def finish() -> None:
            nonlocal sink, count, size
            name = f"pages-{part:08d}-{len(done):06d}.warc.gz"
            sink.commit(name)
            done.append((f"{folder}/{name}", count, size))
            sink, count, size = None, 0, 0

        for whole in batches:
            for batch in pieces(whole, "payload"):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if sink is None:
                        sink = store.create()
                    data = member(record(*row))
                    sink.write(data)
                    count, size = count + 1, size + len(data)
                    if size >= file_bytes:
                        finish()
        if sink is not None:
            finish()
        yield rows(_FILES, *zip(*done, strict=True)) if done else rows(_FILES, [], [], [])

    return write


def write_warc(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive every row (page_id, url, html). Returns a lazy (path, records, bytes): writing happens
    when it is read."""
    files.Store(folder)  # exists even without rows
    return plan(pages, least).select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(frugal(_writes(folder.rstrip("/"), file_bytes)), "path string, records long, bytes long")


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    block: bytes


class _Window:
    """The bytes of a file from a place on, fetched in chunks."""

    def __init__(self, read, size: int, at: int):
        self.read, self.size, self.base, self.data, self.skip = read, size, at, b"", 0

    @property
    def at(self) -> int:
        return self.base + self.skip

    def left(self) -> memoryview:
        return memoryview(self.data)[self.skip:]

    def more(self) -> bool:
        end = self.base + len(self.data)
        part = self.read(end, min(CHUNK, self.size - end)) if end < self.size else b""
        self.data, self.base, self.skip = bytes(self.left()) + part, self.at, 0
        return bool(part)

    def drop(self, n: int) -> None:
        self.skip += n


def _starts_record(data: bytes) -> bool | None:
    """Whether a gzip member at the start of ``data`` opens with a version line; None: too short to say."""
    try:
        head = zlib.decompressobj(31).decompress(data, 16)
    except zlib.error:
        return False
    if len(head) < 8:
        return None if b"WARC/1.1".startswith(head[:8]) or head[:5] == b"WARC/"[:len(head)] else False
    return re.match(rb"WARC/\d\.\d", head) is not None


def _inflate(window: _Window) -> bytes:
    """The content of the member at the window's start; the window moves past it."""
    inflater, out = zlib.decompressobj(31), []
    while True:
        part = window.left()[:STEP]
        if not part and not window.more():
            raise ValueError("a record is cut off")
        out.append(inflater.decompress(part))
        window.drop(len(part) - len(inflater.unused_data))
        if inflater.eof:
            return b"".join(out)


def records(read, size: int, start: int, stop: int) -> Iterator[Record]:
    """The records of a file that start in [start, stop)."""
    window = _Window(read, size, start)
    while True:  # to the first member
        place = window.data.find(MAGIC, window.skip) - window.skip
        if place < 0:
            window.drop(max(0, len(window.left()) - 2))
            if window.at >= stop or not window.more():
                return
            continue
        window.drop(place)
        if window.at >= stop:
            return
        verdict = _starts_record(window.left())
        if verdict is None and window.more():
            continue
        if verdict:
            break
        window.drop(1)
    while window.at < stop and window.at < size:
        offset = window.at
        data = _inflate(window)
        head, _, block = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        yield Record(offset, headers, block[:int(headers["content-length"])])


def _http(r: Record) -> tuple[bytes, int]:
    """The payload of a record's block, and its length: an HTTP response without its head, else the whole block. A
    revisit says in its head how long the payload is that it leaves out."""
    if not r.headers.get("content-type", "").startswith("application/http"):
        return r.block, len(r.block)
    head, _, payload = r.block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length: *(\d+)", head)
    return payload, int(stated[1]) if stated and r.headers.get("warc-type") == "revisit" else len(payload)


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


_READ = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
                   ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())])
_READ_DDL = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, intact boolean"


def _reads(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: list[tuple] = []
                held = 0
                for r in records(*files.opened(path), start, stop):
                    payload, length = _http(r)
                    kind, stated = r.headers.get("warc-type"), r.headers.get("warc-payload-digest")
                    digest, whole = (stated or "").removeprefix("sha1:"), True
                    if "warc-block-digest" in r.headers:
                        whole = _sha1(r.block) == r.headers["warc-block-digest"].removeprefix("sha1:")
                    if kind == "response" and stated is not None:
                        whole &= _sha1(payload) == digest
                    out.append((path, r.offset, kind, r.headers.get("warc-record-id"), r.headers.get("warc-target-uri"), r.headers.get("warc-refers-to"),
                                digest if stated is not None else None, length, payload if with_payload and kind != "revisit" else None, whole))
                    held += len(payload) if with_payload else 100
                    if held > CHUNK:
                        yield rows(_READ, *zip(*out, strict=True))
                        out, held = [], 0
                if out:
                    yield rows(_READ, *zip(*out, strict=True))

    return read


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Every record of the folder's archives, of any type; ``intact`` tells whether the SHA-1 digests that it
    states hold. Ranges are dealt over as many tasks as the session has shuffle partitions."""
    found = files.listing(spark, folder, "*.warc.gz").where("length > 0")
    ranges = found.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("stop", F.col("start") + split_bytes)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "path", "start").mapInArrow(frugal(_reads(payload)), _READ_DDL)


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
