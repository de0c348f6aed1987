"""WARC archives: records written from pages, payload duplicates resolved to revisit records, archives read back.

An archive is a run of gzip members, one for each record, so that records can be sought. Archives are bounded by bytes and
written by Spark's own text writer, one row a file, so they can be in any file system that Spark reaches. Only headers and
digests are shuffled to find the response that others revisit.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm._common import bounded_batches, joined, removed, scratch, shipped, written

shipped(__name__)

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive ends with the record that brings it to so many bytes, compressed; and bytes of parsed records that are handed on together.
FILE_BYTES, BATCH = 16 << 20, 2 << 20
#: zlib's level, and bytes that are unpacked at a time.
LEVEL, PIECE = 1, 4096
#: A gzip member without content: what the text writer puts at the end of each file.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" + "0300" + "00" * 8)

SCHEMA = "record_id string, record_type string, page_id long, uri string, date string, payload_digest string, payload_bytes long, refers_to_id string, payload binary"


def _uuid(*parts: str | None) -> str:
    h = hashlib.md5("|".join(p or "" for p in parts).encode("utf-8", "surrogateescape"), usedforsecurity=False).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(record_type: str, record_id: str | None, page_id: int | None, uri: str | None, date: str, digest: str | None, size: int, payload: bytes, refers_to: str | None = None, refers_uri: str | None = None) -> bytes:
    """A WARC/1.1 record. Headers without a value are left out, line breaks within values go. A revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = record_type == "revisit"
    headers = (
        ("WARC-Type", record_type),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", digest and f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", refers_to if revisit else None),
        ("WARC-Refers-To-Target-URI", refers_uri if revisit else None),
        ("X-Page-ID", page_id),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(http) + (0 if revisit else size)),
    )
    lines = "".join(f"{k}: {str(v).translate({10: None, 13: None})}\r\n" for k, v in headers if v is not None)
    return b"".join((b"WARC/1.1\r\n", lines.encode("utf-8", "replace"), b"\r\n", http, b"" if revisit else payload, b"\r\n\r\n"))


def _archives(records: Iterable[bytes], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row for each archive: its records' members on end."""
    members, size = [], 0
    for data in records:
        c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        members += (c.compress(data), c.flush())
        size += len(members[-2]) + len(members[-1])
        if size >= file_bytes:
            yield pa.record_batch({"value": pa.array([b"".join(members)], pa.binary())})
            members, size = [], 0
    if members:
        yield pa.record_batch({"value": pa.array([b"".join(members)], pa.binary())})


def _write(archives: DataFrame, path: str) -> None:
    """Each row of archives (value binary) as one file; the text writer takes the bytes as they are."""
    text = archives.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def write_archives(pages: DataFrame, path: str, date: str, file_bytes: int = FILE_BYTES) -> None:
    """Write a response record for each page (page_id, url, html); a null html has an empty payload, a null url no header."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html = (batch.column(c)[k].as_py() for c in range(3))
                digest = hashlib.sha1(html, usedforsecurity=False).hexdigest()
                yield record("response", _uuid("page", None if page is None else str(page), url, digest), page, url, date, digest, len(html), html)

    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    _write(narrow.mapInArrow(lambda batches: _archives(records(batches), file_bytes), "value binary"), path)


class _Gunzip(io.RawIOBase):
    """Reads gzip members that follow one another as one stream, piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.at, self.inner, self.ready = memoryview(data), 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.ready:
            if self.inner.eof:
                self.inner = zlib.decompressobj(31)
            piece = self.data[self.at : self.at + PIECE]
            if not len(piece):
                return 0
            self.ready = self.inner.decompress(piece)
            self.at += len(piece) - len(self.inner.unused_data)
        n = min(len(target), len(self.ready))
        target[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, gzip or plain; Content-Length alone says where a block ends."""
    stream = io.BufferedReader(_Gunzip(data), 1 << 16) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def _rows(payloads: bool):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for k in range(batch.num_rows):
                for headers, block in parse(batch.column(0)[k].as_py()):
                    head, _, body = block.partition(b"\r\n\r\n")
                    kind = headers.get("warc-type")
                    if kind == "response":
                        digest, length = hashlib.sha1(body, usedforsecurity=False).hexdigest(), len(body)
                    else:
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None
                        length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                    page = headers.get("x-page-id")
                    uri = headers.get("warc-target-uri")
                    rows.append((headers.get("warc-record-id"), kind, page and int(page), uri and uri.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), headers.get("warc-date"), digest, length, headers.get("warc-refers-to"), body if payloads else None))
                    size += len(body) * payloads + 400
                    if size > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder. payload_digest (SHA-1, hexadecimal) is computed from a response's payload."""
    bounded_batches(spark)
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(_rows(payloads), SCHEMA)


def _decisions(headers: DataFrame, least_bytes: int) -> DataFrame:
    """record_id, record_type, kind, kept_id and kept_uri for each record of a group of equal large payloads."""
    response = F.col("record_type") == "response"
    # a struct compares page_id first; nulls are the least
    keep = F.max(F.when(response, F.struct("page_id", "record_id", "uri")))
    large = headers.where((F.col("payload_bytes") >= least_bytes) & F.col("record_id").isNotNull())
    kept = large.groupBy("payload_digest", "payload_bytes").agg(keep.alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null")
    both = joined(large, kept.drop("n"), ["payload_digest", "payload_bytes"], "inner")
    kind = F.when(response & F.col("page_id").eqNullSafe(F.col("kept.page_id")), "response").otherwise("revisit")
    return both.select("record_id", "record_type", kind.alias("kind"), F.col("kept.record_id").alias("kept_id"), F.col("kept.uri").alias("kept_uri")).dropDuplicates(["record_id", "record_type"])


def _rewritten(date: str, file_bytes: int):
    """Rows of records with their decisions as new archives."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                refers = _uuid(date, r["kept_id"]) if r["kept_id"] is not None else r["refers_to_id"]
                yield record(r["kind"] or r["record_type"], _uuid(date, r["record_id"]), r["page_id"], r["uri"], date, r["payload_digest"], r["payload_bytes"], r["payload"] or b"", refers, r["kept_uri"])

    return lambda batches: _archives(records(batches), file_bytes)


def resolve_revisits(spark: SparkSession, source: str, target: str, date: str, least_bytes: int = 1000, file_bytes: int = FILE_BYTES) -> None:
    """Rewrite the archives in source so that each payload of least_bytes or more is kept once.

    Of the responses with equal payloads the one with the largest page_id stays (a null page_id is smaller than any); the
    others, and revisit records of the same digest, refer to it. Responses that repeat that page_id stay too. All
    records get fresh ids and dates. A revisit whose response is missing, and a record without an id, stay as they were.
    """
    headers, path = written(read_archives(spark, source, payloads=False).drop("payload", "date", "refers_to_id"), "warc-headers")
    decisions, decided = written(_decisions(headers, least_bytes), "warc-decisions")
    records = joined(read_archives(spark, source), decisions, ["record_id", "record_type"], "left")
    _write(records.mapInArrow(_rewritten(date, file_bytes), "value binary"), target)
    removed(spark, path)
    removed(spark, decided)


def page_revisits(pages: DataFrame, least_bytes: int = 1000, date: str | None = None) -> DataFrame:
    """Write pages (page_id long, url, html) as archives, resolve the revisits, and read the new archives back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to (the response's page_id, null for
    responses) for every row. A null html is an empty payload, a null url has no target header. Payloads may be of any
    length that a Spark row holds. Rows that repeat a page_id with the same payload have the same record type. An empty
    table gives an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    source, target = scratch(spark, "warc"), scratch(spark, "warc-resolved")
    write_archives(pages, source, date)
    resolve_revisits(spark, source, target, date, least_bytes)
    removed(spark, source)
    found, _ = written(read_archives(spark, target, payloads=False).drop("payload", "uri", "date"), "warc-result")
    removed(spark, target)
    wanted = found.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id")).distinct()
    responses = found.where("record_type = 'response'").join(wanted, "record_id", "left_semi")
    responses = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    out = joined(found, responses, ["refers_to_id"], "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
