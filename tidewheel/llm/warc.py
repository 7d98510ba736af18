"""WARC archives with revisit records, segmented records and chunked payloads: written and read by Spark.

Writing: equal payloads are stored once, as the response of the least id; the others are revisit records that refer to
it. A response's body is an HTTP message in chunked transfer framing; one longer than a segment is split into a first
record and continuation records, which may come to lie in other files. Spark's text writer puts the records into gzip
files, with the blank lines that end a WARC record as its separator, so archives go wherever Spark can write.

Reading: segment reassembly. Continuation records are grouped with the first by origin id, put in order of segment
number, checked against the total length that the last one states, and then decoded like whole records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, lookup, scratch_path, table, written

#: Bytes of a record's body, bytes of a chunk, records of a file (so that a file holds 32 MB at most).
SEGMENT, CHUNK, PER_FILE = 16 * 1024, 4096, 2000
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = "page_id long, record_type string, url string, payload_digest string, refers_to long, payload binary"
PIECE = "origin string, number int, total long, page_id long, url string, payload_digest string, body binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; ValueError if it is not whole."""
    at, out = 0, []
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it should")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, key: str, fields: dict[str, object], body: bytes) -> bytes:
    """Without the blank lines at its end."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{key}>", "WARC-Date": "2024-01-01T00:00:00Z", **fields, "Content-Length": len(body)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)).encode() + b"\r\n" + body


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, segment: int, place: str = "") -> Iterator[bytes]:
    """place: what tells a row without an id from others."""
    digest = base32_sha1(payload)
    key = lambda i: f"urn:x-page::{digest}:{place}" if i is None else f"urn:x-page:{i}:{digest}"
    url = url if url is None else re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", key(page_id) + ":revisit", fields | {"WARC-Profile": profile, "WARC-Refers-To": f"<{key(refers_to)}>"}, HTTP)
        return
    body = HTTP + chunked(payload)
    parts = [body[i : i + segment] for i in range(0, len(body), segment)]
    for number, part in enumerate(parts, 1):
        more = {"WARC-Segment-Number": number} if len(parts) > 1 else {}
        if number == 1:
            yield record("response", key(page_id), fields | more, part)
        else:
            more |= {"WARC-Segment-Origin-ID": f"<{key(page_id)}>", "WARC-Segment-Total-Length": len(body) if number == len(parts) else None}
            yield record("continuation", f"{key(page_id)}:{number}", more, part)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT) -> None:
    """One record for each row (and continuations). A null payload is empty, a null url is left out. Rows without an id come
    after all others when payloads are equal; rows that repeat the least id of equal payloads are responses too. A very
    long payload is written in segments. An empty table gives an archive without records; other columns are ignored."""
    rows = columns(pages, page_id=F.col(page_id).cast("long"), url=url, payload=F.coalesce(F.col(html), F.lit("")).cast("binary"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    equal = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    equal = written(equal, "equal-payloads")
    rows = lookup(rows, equal, "sha", "n", rows.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for key, link, value, first in zip(*(batch.column(k) for k in range(4))):
                key, first, row = key.as_py(), first.as_py(), row + 1
                found = list(records(key, link.as_py(), value.as_py(), first, first is not None and key != first, segment, f"{part}-{row}"))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["record"])

    lines = rows.select("page_id", "url", "payload", "first").mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: fields and body."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        yield fields, data[stop + 4 : stop + 4 + size]
        if data[stop + 4 + size : stop + 8 + size] != END:
            raise ValueError("a record is longer or shorter than it says")
        at = stop + 8 + size


def key_of(field: str) -> int | None:
    key = field.strip("<>").split(":")[2]
    return int(key) if key else None


def decoded(body: bytes, digest: str) -> bytes:
    """The payload of an HTTP message, checked against its digest."""
    head, _, rest = body.partition(END)
    payload = unchunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest
    if base32_sha1(payload) != digest:
        raise ValueError(f"a payload does not have the digest {digest}")
    return payload


def read(spark: SparkSession, path: str) -> DataFrame:
    """RECORD: one row for each response or revisit record; revisits have no payload of their own (null).

    Archives without records give no rows; a record's further fields are ignored. Rows come in no order, repeated records
    as often as they occur; a very long payload is put together in one task.
    ValueError for a record, chunk or segment that is cut off or missing, and for a payload that does not have its digest.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = []
                for f, body in parsed(gzip.decompress(content.as_py())):
                    if "WARC-Segment-Number" in f:
                        continue
                    digest, revisit = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"] == "revisit"
                    out.append((key_of(f["WARC-Record-ID"]), f["WARC-Type"], f.get("WARC-Target-URI"), digest, key_of(f["WARC-Refers-To"]) if revisit else None, None if revisit else decoded(body, digest)))
                if out:
                    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], [x.split()[0] for x in RECORD.split(", ")])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = []
                for f, body in parsed(gzip.decompress(content.as_py())):
                    if "WARC-Segment-Number" in f:
                        total, digest = f.get("WARC-Segment-Total-Length"), f.get("WARC-Payload-Digest")
                        out.append((f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), int(f["WARC-Segment-Number"]), int(total) if total else None, key_of(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), digest and digest.removeprefix("sha1:"), body))
                if out:
                    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], [x.split()[0] for x in PIECE.split(", ")])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, key, url, digest, parts in zip(*(batch.column(k) for k in range(5))):
                by_number: dict[int, list[dict]] = {}
                for p in parts.as_py():
                    by_number.setdefault(p["number"], []).append(p)
                body = b"".join(by_number[k][0]["body"] for k in sorted(by_number))
                total = by_number[max(by_number)][0]["total"]
                if sorted(by_number) != list(range(1, len(by_number) + 1)) or total != len(body) or len({len(x) for x in by_number.values()}) > 1:
                    raise ValueError(f"segments of {origin.as_py()} are missing")
                copies = len(by_number[1])  # rows repeated in full share one origin id
                columns = [[key.as_py()], ["response"], [url.as_py()], [digest.as_py()], [None], [decoded(body, digest.as_py())]]
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x * copies, t) for x, t in zip(columns, types)], [x.split()[0] for x in RECORD.split(", ")])

    part = F.struct("number", "total", "body")
    grouped = files.mapInArrow(pieces, PIECE).groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("payload_digest").alias("payload_digest"), F.collect_list(part).alias("parts"))
    return files.mapInArrow(whole, RECORD).unionByName(grouped.mapInArrow(joined, RECORD))


def resolved(found: DataFrame) -> DataFrame:
    """read()'s rows without their payloads, but with payload_bytes: of a revisit, those of the response it refers to."""
    slim = written(found.select("page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes")), "records")
    again = slim.where("record_type = 'revisit'").drop("payload_bytes")
    n = again.groupBy("payload_digest").agg(F.count("*").alias("n"))
    first = slim.where("record_type = 'response'").groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    first = written(first.join(n, "payload_digest"), "revisited")
    back = lookup(again, first, "payload_digest", "n", slim.count())
    return slim.where("record_type = 'response'").unionByName(back)


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record after writing and reading; see write and read for nulls, ties, repeats and empty tables."""
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return resolved(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""
