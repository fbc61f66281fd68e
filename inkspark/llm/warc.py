"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes`` of WARC text; a bundle of about
``bundle_bytes`` ends with the seek table of the seekable format (a skippable frame: compressed and decompressed size of each
frame). With it goes the map from record ids to (frame, offset in the frame, length), so that one record costs one frame.

Of records with equal payloads of at least ``min_revisit_bytes`` the one with the largest id is a response, the others revisit it; smaller
payloads are all responses. A revisit keeps the HTTP headers, with the payload's length, but not the payload.

Scale: equal payloads are found by digest, with a partial aggregate; pages are shuffled once, by the join with their digest's response
(adaptive execution splits a digest with many pages); each task streams its rows into bundles and holds one bundle. Bundles are
rows of a Parquet table in the shared folder, so only Spark's readers and writers touch the store, and a lost task is redone whole.

Edge cases: a null html is an empty payload; a null url leaves the target header out; control characters in a url are
percent-encoded; a null id can only be a revisit, of the largest id with its payload, or a response if there is none; rows that
repeat the response's id and payload are responses too; a page larger than a frame or bundle gets one of its own; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import table, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # magic numbers of the seekable format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLES = "bundle string, data binary, records array<struct<record_id:string,id:long,frame:int,offset:long,length:long>>"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, payload binary"


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, response: int | None, date: str) -> bytes:
    """One WARC/1.1 record; ``response`` is the id it revisits, None for a response."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if page is not None:
        lines.append(f"Page-Id: {page}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if response is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(response)}", f"Refers-To-Page-Id: {response}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    return fields | {"payload": payload, "payload-length": length}


class Bundle:
    """Frames so far, the open frame, and where each record is."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.zip = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.sizes, self.open, self.fill, self.records, self.raw = [], [], [], 0, [], 0

    def add(self, page: int | None, data: bytes) -> None:
        self.records.append({"record_id": record_id(page), "id": page, "frame": len(self.frames), "offset": self.fill, "length": len(data)})
        self.open.append(data)
        self.fill += len(data)
        self.raw += len(data)
        if self.fill >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            packed = self.zip.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.fill))
            self.open, self.fill = [], 0

    def bytes(self) -> bytes:
        self.end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    base = len(data) - 9 - n * width
    for i in range(n):
        packed, size = struct.unpack_from("<II", data, base + i * width)
        out.append((at, packed, size))
        at += packed
    return out


def bundled(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, bundle_bytes: int = 16 << 20, frame_bytes: int = 256 << 10, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the pages as bundles: a table of (bundle, data, records)."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    last = rows.groupBy("digest").agg(F.max("id").alias("response"))
    large = F.octet_length("payload") >= min_revisit_bytes
    refers = F.when(large & F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")), F.col("response"))
    ready = rows.join(last, "digest").select("id", "url", "payload", refers.alias("response"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("records", pa.list_(pa.struct([("record_id", pa.string()), ("id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])
        one = Bundle(frame_bytes, level)

        def out(b: Bundle) -> pa.RecordBatch:
            data = b.bytes()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()[:32]]), pa.array([data], pa.binary()), pa.array([b.records], schema.field(2).type)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                page, target, body, response = (batch.column(c)[i].as_py() for c in range(4))
                one.add(page, record(page, target, body, response, date))
                if one.raw >= bundle_bytes:
                    yield out(one)
                    one = Bundle(frame_bytes, level)
        if one.records:
            yield out(one)

    return written(ready.mapInArrow(run, BUNDLES), "bundles")


def fetched(bundles: DataFrame, ids: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """Read records back through the map and the seek tables, frame by frame: those of ``ids`` (a column id), or all."""
    wanted = bundles
    if ids is not None:
        one = bundles.select("bundle", F.explode("records").alias("r")).join(ids.select(F.col("id").alias("_id")).distinct(), F.col("r.id") == F.col("_id"), "left_semi")
        wanted = bundles.select("bundle", "data").join(one.groupBy("bundle").agg(F.collect_list("r").alias("records")), "bundle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                data, records = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                frames = seek_table(data)
                at, text, rows = -1, b"", []
                for r in sorted(records, key=lambda r: (r["frame"], r["offset"])):
                    if r["frame"] != at:
                        at = r["frame"]
                        offset, packed, size = frames[at]
                        text = unzip.decompress(data[offset : offset + packed], max_output_size=size)
                    x = parse(text[r["offset"] : r["offset"] + r["length"]])
                    page, refers = x.get("page-id"), x.get("refers-to-page-id")
                    rows.append((page and int(page), x["payload-length"], x["warc-payload-digest"].removeprefix("sha1:"), x["warc-type"], refers and int(refers), x["warc-record-id"], x.get("warc-target-uri"), x["payload"] if payloads else None))
                    if len(rows) >= 2_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return wanted.select("data", "records").mapInArrow(run, READ)


def query(spark, sf_dir: str) -> DataFrame:
    back = fetched(bundled(table(spark, sf_dir, "pages")), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: base32 of the digest from its bits, five at a time
ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, unhex(sha1(body))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY body) AS response FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
 + 16 * substr(bits, i + 1, 1)::INT + 8 * substr(bits, i + 2, 1)::INT + 4 * substr(bits, i + 3, 1)::INT + 2 * substr(bits, i + 4, 1)::INT + substr(bits, i + 5, 1)::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to FROM q"""
