import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from scorelake.llm import files, warc
from scorelake.llm.queries import folder_for

ROWS = [(5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, "http://a/3\r\nX: y", "same"), (3, "http://a/4", "same"), (1, None, None), (2, "u", ""), (4, "u", "<p>é日</p>\r\n\r\nWARC/1.1"),
        (None, "u", "alone"), (None, "u", "same"), (7, "u", "".join(chr(0x100 + i * 7919 % 50000) for i in range(60_000)).encode("utf-8", "replace").decode())]


def pages(spark):
    return spark.createDataFrame([(*r, "extra", 1) for r in ROWS], "page_id long, url string, html string, digest string, first int")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(least=0):
    out = []
    for page_id, _, html in ROWS:
        same = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None] if len((html or "").encode()) >= least else []
        first = min(same, default=None)
        other = first is not None and first != page_id and len(same) and max(same) != first
        out.append((page_id, len((html or "").encode()), digest(html), "revisit" if other else "response", first if other else None))
    return sorted(out, key=str)


def read(spark, folder, **options):
    got = warc.read_warc(spark, folder, **options)
    return got.select(warc.page_of(F.col("record_id")).alias("p"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("r"), "intact", "payload", "path", "offset").collect()


def test_round_trip_at_any_split(spark):
    for least in (0, 10):
        folder = folder_for(spark, "test-warc")
        written = warc.write_warc(pages(spark), folder, least=least).collect()
        assert sum(r["records"] for r in written) == len(ROWS)
        for split in (37, 1000, 1 << 25):
            got = read(spark, folder, split_bytes=split)
            assert sorted((tuple(r)[:5] for r in got), key=str) == brute(least) and all(r["intact"] for r in got)
            assert len({(r["path"], r["offset"]) for r in got}) == len(ROWS)


def test_archives_are_plain_gzip(spark):
    folder = folder_for(spark, "test-warc")
    paths = [r["path"] for r in warc.write_warc(pages(spark), folder, file_bytes=300).collect()]
    assert len(paths) > 1
    text = b"".join(gzip.decompress(files.opened(p)[0](0, files.opened(p)[1])) for p in paths)
    assert text.count(b"WARC/1.1\r\nWARC-Type") == len(ROWS)


def test_magic_inside_a_member():
    """Stored blocks keep a magic readable inside a record; it must not be taken for a start."""
    trap = warc.MAGIC + b"\x00" * 7 + b"WARC/1.1" + warc.member(b"not a record")
    data = b"".join(warc.member(warc.record(i, "u", trap * 3, "D", None), level=0) for i in range(4))
    read_at = lambda at, n: data[at:at + n]
    whole = [r.offset for r in warc.records(read_at, len(data), 0, len(data))]
    assert len(whole) == 4
    for step in (11, 64, 500):
        assert [r.offset for a in range(0, len(data), step) for r in warc.records(read_at, len(data), a, a + step)] == whole


def test_records_of_other_kinds(spark):
    """What other crawlers write around their responses."""
    def other(kind, block, *head):
        lines = [f"WARC-Type: {kind}", *head, f"Content-Length: {len(block)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(lines)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc"
    made = [other("warcinfo", b"software: x\r\n\r\n", "Content-Type: application/warc-fields"),
            other("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a"),
            other("response", http, "Content-Type: application/http; msgtype=response", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(http).digest()).decode()),
            other("metadata", b"fetchTimeMs: 4", "WARC-Record-ID: <urn:uuid:1>"), warc.record(7, "u", b"own", digest("own"), None),
            other("response", http, "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + digest("abd"))]
    folder = folder_for(spark, "test-warc")
    out = files.Store(folder).create()
    out.write(b"".join(map(warc.member, made)))
    out.commit("foreign.warc.gz")
    for split in (50, 1 << 20):
        got = sorted(read(spark, folder, split_bytes=split), key=lambda r: r["offset"])
        assert [(r["record_type"], r["payload_bytes"], bytes(r["payload"]), r["intact"]) for r in got] == [
            ("warcinfo", 15, b"software: x\r\n\r\n", True), ("request", 0, b"", True), ("response", 3, b"abc", True), ("metadata", 14, b"fetchTimeMs: 4", True),
            ("response", 3, b"own", True), ("response", 3, b"abc", False)]
        assert [r["payload_digest"] for r in got] == [None, None, None, None, digest("own"), digest("abd")]


def test_ranges_are_read_by_many_tasks(spark):
    folder = folder_for(spark, "test-warc")
    many = spark.range(600).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    warc.write_warc(many, folder, file_bytes=2000).collect()
    got = warc.read_warc(spark, folder, payload=False)
    assert got.select("path").distinct().count() > 40 and got.count() == 600
    assert got.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_empty(spark):
    folder = folder_for(spark, "test-warc")
    assert warc.write_warc(pages(spark).limit(0), folder).collect() == []
    assert read(spark, folder) == []
