"""WARC archives as Zstandard frames, one frame per record, with a dictionary up front.

An archive begins with a skippable frame that holds its dictionary, trained on the archive's own
first records; then comes one frame per record. Writing is Spark's own text sink: each row is the bytes
of a frame, and the line separator is an empty skippable frame, which every reader passes over. So
archives are committed task by task, to any file system that Spark knows. Reading goes
through Spark's binary file source; a record's length, content length, block digest
and payload digest are all validated.

Equal payloads are written once: of the pages with a payload of ``MIN_PAYLOAD`` bytes or more, the
one with the smallest page_id is a response and the others are revisits of it without a payload,
whose HTTP header keeps the payload's length. A response's record id is its page_id and payload digest, any other's its
page_id and a number of its own, so no two records share one. Pages are dealt to archives of about ``ARCHIVE`` bytes of
payload, so a reader holds no more of one than that.

Cases: a null html is an empty payload; a null url leaves the target out; control characters in a url
are percent-encoded; of rows that repeat the smallest page_id one is the response and the others revisit it; a null
page_id comes after all others, and a revisit of a response without page_id refers to none; extra columns are ignored; an
empty table gives no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, drop, read, save, scratch_path, small_batches

MIN_PAYLOAD = 0
#: Fixed values of the formats: magic numbers, and the profile of a revisit.
FRAME = 0xFD2FB528
SKIPPABLE = 0x184D2A50
DICTIONARY = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame. All its bytes are ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode()
DATE = "2024-01-01T00:00:00Z"
#: Records and bytes that a dictionary is trained on, its size, and the compression level.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 200, 1 << 20, 16384, 3
#: Payload bytes of an archive, and of the smaller ones that a small table is dealt to.
ARCHIVE, SMALL_ARCHIVE = 256 << 20, 8 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id, own: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{own}>"


def record(page_id, url: str | None, payload: bytes | None, own: str, revisits: tuple | None = None) -> bytes:
    """One WARC record. ``revisits``: (page_id, payload length, payload digest) of the response that it repeats."""
    target, length, sha1 = revisits or (None, len(payload), digest(payload))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if revisits else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {_uri(page_id, own)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisits:
        head += [f"WARC-Refers-To: {_uri(target, sha1)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes]) -> bytes:
    """A dictionary for these records; none if they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records):
    """The frames of an archive, dictionary first, from any number of records."""
    head, size = [], 0
    records = iter(records)
    for r in records:
        head.append(r)
        size += len(r)
        if len(head) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
            break
    if not head:
        return
    words = trained(head)
    yield struct.pack("<II", DICTIONARY, len(words)) + words
    options = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **options)
    for r in head:
        yield packer.compress(r)
    for r in records:
        yield packer.compress(r)


def frame_end(data, at: int) -> tuple[int, int]:
    """(end of the frame at ``at``, its content size), from its header and its blocks' headers."""
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    p = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3]
    width = (single, 2, 4, 8)[flags >> 6]
    if not width:
        raise ValueError("a record's frame has no content size")
    size = int.from_bytes(data[p : p + width], "little") + (256 if width == 2 else 0)
    p += width
    last = 0
    while not last:
        block = int.from_bytes(data[p : p + 3], "little")
        if p + 3 > len(data):
            raise ValueError("the archive ends inside a frame")
        last, kind = block & 1, block >> 1 & 3
        p += 3 + (1 if kind == 1 else block >> 3)
    p += 4 * checksum
    if p > len(data):
        raise ValueError("the archive ends inside a frame")
    return p, size


def frames(data: bytes):
    """(offset, record) of every record of an archive."""
    view, at, unpacker = memoryview(data), 0, None
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError("the archive ends inside a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if at == 0 and magic == DICTIONARY:
                words = bytes(view[8 : 8 + size])
                if words[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
                    words = zstandard.ZstdDecompressor().decompress(words)
                if words:
                    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at byte {at}")
        end, size = frame_end(view, at)
        unpacker = unpacker or zstandard.ZstdDecompressor()
        out = unpacker.decompress(view[at:end], max_output_size=max(1, size))
        if len(out) != size:
            raise ValueError(f"the frame at byte {at} has {len(out)} bytes and says {size}")
        yield at, out
        at = end


def parse(data: bytes) -> dict:
    """A record's fields, after validating its header, lengths and digests."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("a record has no WARC header")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    missing = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} - fields.keys()
    if missing:
        raise ValueError(f"a record has no {sorted(missing)}")
    length = int(fields["Content-Length"])
    block = rest[:length]
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's content length is wrong")
    if fields.get("WARC-Block-Digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError("a record's block digest is wrong")
    http, found, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    size = int(said[1]) if said else len(payload)
    if fields["WARC-Type"] == "response" and (size != len(payload) or fields.get("WARC-Payload-Digest") != f"sha1:{digest(payload)}"):
        raise ValueError("a response's payload differs from its header")
    return fields | {"payload": payload, "payload_bytes": size}


def _written(min_payload: int):
    def records(batches):
        for b in batches:
            for n, page_id, url, html, revisit, first in zip(*(b.column(i).to_pylist() for i in range(6))):
                html = html or b""
                if revisit:
                    yield record(page_id, url, None, str(n), (first, len(html), digest(html)))
                else:
                    yield record(page_id, url, html, digest(html) if len(html) >= min_payload else str(n))

    def run(batches):
        for frame in archive(records(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["frame"])

    return run


def write(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Write ``pages`` (page_id, url, html) as archives under ``path``."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce("html", F.lit("")).cast("binary")
    # numbered once and written, so that every later step sees the same numbers
    pages = save(pages.select(F.monotonically_increasing_id().alias("n"), "page_id", "url", html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("size")), "pages", "zstd")
    ids = pages.select("n", "page_id", "sha1", "size").where(F.col("size") >= min_payload)
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("first")
    first = ids.groupBy("sha1").agg(least, F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha1", "first")
    again = save(ids.join(first, "sha1").where("n <> first.n").select("n", F.lit(True).alias("revisit"), F.col("first.page_id").alias("first")), "revisits")
    total = pages.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, -(-total // ARCHIVE), min(buckets(spark), -(-total // SMALL_ARCHIVE)))
    rows = pages.select("n", "page_id", "url", "html").repartition(parts, "n").join(again.repartition(parts, "n"), "n", "left")
    rows = rows.select("n", "page_id", "url", "html", F.coalesce("revisit", F.lit(False)).alias("revisit"), "first")
    rows.mapInArrow(_written(min_payload), "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).text(path)
    drop(pages, again)


def _parsed(batches):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    number = lambda uri: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+):\w+>", uri or "")) else None
    for b in batches:
        for name, data in zip(b.column(0).to_pylist(), b.column(1)):
            rows = []
            for at, raw in frames(data.as_buffer()):
                r = parse(raw)
                rows.append((number(r["WARC-Record-ID"]), r["payload_bytes"], r.get("WARC-Payload-Digest", "").removeprefix("sha1:"), r["WARC-Type"], number(r.get("WARC-Refers-To")), r.get("WARC-Target-URI"), name, at))
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``; a worker holds one archive at a time."""
    small_batches(spark, 1)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_parsed, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS nth FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{letters}', (((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first END AS refers_to
FROM r JOIN f USING (h)"""
