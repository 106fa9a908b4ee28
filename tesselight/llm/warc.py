"""WARC from legacy archives (operator 7).

:func:`arc_bytes` and :func:`parse_arc` speak the two versions of the ARC format: a version block
names the fields of the header lines that follow, each header line declares its record's length,
and version 2 adds result code, checksum, location, offset and file name. :func:`convert` turns
parsed records into WARC/1.1 records: an identifier (UUID) made from URL, date and place, an ISO
timestamp from the 14 digits, a type, and SHA-1 digests. Archives are kept as gzip members, one
for each record, packed into segments (rows of ``archive``, ``seq``, ``data``) of a table below the
shared folder, so that any store that the cluster shares will do; :func:`export` writes them as
plain ``.warc.gz`` files. An archive's version block becomes a warcinfo record, a body that is an HTTP
response a response, any other body a resource.

:func:`convert_files` converts stored ``.arc`` and ``.arc.gz`` files. :func:`write` takes a table of
pages the same way: each task puts its pages into legacy archives, of both versions in turn, and
parses and converts those.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is a
response and the others are revisits of it, without payload; smaller ones are all responses.

Edge cases: null html is an empty payload; null url is written as ``-``; null page_ids count as
larger than all others; rows that share the smallest page_id and the payload are all responses;
an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written

#: Fixed by the two versions of the format.
FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length")}
NAMES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
SEGMENT_BYTES = 4 << 20
SEGMENT = "archive int, seq int, data binary"
PARSED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, warc_date string, record_id string"


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    code: str
    body: bytes


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_bytes(records: list[ArcRecord], version: int, name: str = "legacy.arc") -> bytes:
    """An uncompressed ARC file of the given version."""
    head = f"{version} 0 legacy\n{NAMES[version]}\n".encode()
    common = f"filedesc://{name} 0.0.0.0 20000101000000 text/plain"
    extra = " 200 - - 0 " + name if version == 2 else ""
    out = [f"{common}{extra} {len(head)}\n".encode(), head, b"\n"]
    place = sum(map(len, out))
    for r in records:
        more = f" {r.code} {sha1(r.body)} - {place} {name}" if version == 2 else ""
        line = f"{r.url} {r.ip} {r.date} {r.mime}{more} {len(r.body)}\n".encode()
        out += [line, r.body, b"\n"]
        place += len(line) + len(r.body) + 1
    return b"".join(out)


def parse_arc(data: bytes, block: bool = False) -> Iterator[ArcRecord]:
    """Records of an ARC file of either version, by the lengths that its header lines declare.

    ``block``: the version block too, as first record; its code is the version.
    """
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "surrogateescape").split(" ")
        length = int(values[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"record at byte {at} declares {length} bytes, {len(body)} are left")
        at = end + 1 + length
        if fields is None:  # the version block
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = FIELDS[version]
            if block:
                yield ArcRecord(values[0], values[1], values[2], values[3], str(version), body)
            continue
        if len(values) > len(fields):  # old URLs may hold spaces
            values = [" ".join(values[: len(values) - len(fields) + 1]), *values[len(values) - len(fields) + 1 :]]
        r = dict(zip(fields, values))
        yield ArcRecord(r["url"], r["ip"], r["date"], r["type"], r.get("code", "200"), body)


def stamp(date: str) -> str:
    """ISO timestamp of an ARC date of 14 digits (older archives: 12 or 8)."""
    d = (date + "0" * 14)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def identifier(url: str, date: str, place: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place} {date} {url}')}>"


def convert(r: ArcRecord, place: object, refers: tuple[object, str, str] | None = None, name: object = None) -> bytes:
    """A WARC record of an ARC record whose body is an HTTP response.

    ``place`` is the row it came from (``name``: what else tells its place); ``refers``: the row, URL and date of the record that it
    repeats, which makes it a revisit. A version block becomes a warcinfo record, any other body
    that is no HTTP response a resource.
    """
    if r.url.startswith("filedesc://"):
        block = f"software: tesselight\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {r.code}, {r.url}\r\n".encode("utf-8", "surrogateescape")
        return _record(["WARC-Type: warcinfo", f"WARC-Record-ID: {identifier(r.url, r.date, name or place)}", f"WARC-Date: {stamp(r.date)}", f"WARC-Filename: {r.url[11:]}", f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: application/warc-fields"], block)
    if not r.body.startswith(b"HTTP/"):
        lines = ["WARC-Type: resource", f"WARC-Record-ID: {identifier(r.url, r.date, name or place)}", f"WARC-Date: {stamp(r.date)}", f"WARC-Target-URI: {r.url}", f"WARC-IP-Address: {r.ip}", f"WARC-Payload-Digest: sha1:{sha1(r.body)}", f"WARC-Block-Digest: sha1:{sha1(r.body)}", f"Content-Type: {r.mime}"]
        return _record(lines, r.body)
    http, _, payload = r.body.partition(b"\r\n\r\n")
    block = http + b"\r\n\r\n" + (b"" if refers else payload)
    lines = [
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {identifier(r.url, r.date, name or place)}",
        f"WARC-Date: {stamp(r.date)}",
        f"WARC-Target-URI: {r.url}",
        f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: sha1:{sha1(payload)}",
        f"WARC-Block-Digest: sha1:{sha1(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if place is not None:
        lines.append(f"WARC-Source-Row: {place}")
    if refers:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {identifier(refers[1], refers[2], refers[0])}",
            f"WARC-Refers-To-Target-URI: {refers[1]}",
            f"WARC-Refers-To-Date: {stamp(refers[2])}",
            f"WARC-Refers-To-Source-Row: {refers[0]}",
            "WARC-Truncated: length",
        ]
    return _record(lines, block)


def _record(lines: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file of gzip members."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, start, parts = zlib.decompressobj(31), at, []
        while not z.eof:
            if at >= len(data):
                raise ValueError(f"gzip member at byte {start} is cut")
            chunk = view[at : at + 16384]
            parts.append(z.decompress(chunk))
            at += len(chunk) - len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        yield headers, rest[: int(headers["content-length"])]


def _clean(url: str | None) -> str:
    return "-" if url is None or not url.strip() else "%20".join(url.split())


def _date(page_id: int | None) -> str:
    """A capture date for rows that have none: fixed by the row's number."""
    s = (page_id or 0) % (365 * 86_400)
    return f"2001{1 + s // 86_400 // 31 % 12:02d}{1 + s // 86_400 % 28:02d}{s // 3600 % 24:02d}{s // 60 % 60:02d}{s % 60:02d}"


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    path: str

    def segments(self) -> DataFrame:
        return self.spark.read.schema(SEGMENT).parquet(self.path)

    def records(self) -> DataFrame:
        """The archives' records, read back from their bytes."""

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column(0).to_pylist():
                    rows = []
                    for h, block in parse_warc(data):
                        if h["warc-type"] == "warcinfo":
                            continue
                        if h["warc-type"] == "resource":
                            rows.append((None, len(block), h["warc-payload-digest"].removeprefix("sha1:"), "resource", None, h["warc-target-uri"], h["warc-date"], h["warc-record-id"]))
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        # a revisit has no payload: its length stands in the HTTP header alone; old servers often left it out
                        declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and sha1(payload) != digest:
                            raise ValueError(f"payload of {h['warc-record-id']} does not match its headers")
                        place, refers = h.get("warc-source-row"), h.get("warc-refers-to-source-row")
                        rows.append((place and int(place), declared if refers else len(payload), digest, h["warc-type"], refers and int(refers), h["warc-target-uri"], h["warc-date"], h["warc-record-id"]))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 3]
                    cols = list(zip(*rows)) or [()] * 8
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "warc_date", "record_id"])

        return self.segments().select("data").mapInArrow(parse, PARSED)


def write(pages: DataFrame, least: int = 0, path: str | None = None) -> Archive:
    """Convert ``pages`` (page_id, url, html), taken through ARC, into WARC archives."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    # each payload's first page; partial aggregation leaves a row per payload and task
    key = F.struct(F.sha1("payload").alias("h"), F.length("payload").alias("n"))
    pages = pages.withColumn("key", key)
    first = pages.where(F.length("payload") >= least).groupBy("key").agg(F.min(F.struct(F.col("page_id").isNull().alias("z"), F.col("page_id"), F.col("url"))).alias("first"), F.count("*").alias("many")).where("many > 1")
    # a table of its own, so that the join below can be dealt anew where one payload has many pages
    first = written(first.select(F.col("key").alias("key2"), "first"), "firsts")
    linked = pages.join(first, F.col("key") == F.col("key2"), "left").select("page_id", "url", "payload", F.coalesce("first.page_id", "page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    out = path or scratch(spark, "warc")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, seq, held = TaskContext.get().partitionId(), 0, 0
        pending: list[tuple[ArcRecord, object, tuple | None]] = []

        def segment() -> pa.RecordBatch:
            nonlocal seq, held
            legacy = arc_bytes([r for r, _, _ in pending], 1 + seq % 2, f"{archive}-{seq}.arc")
            members = []
            for r, (_, page, refers) in zip(parse_arc(legacy, block=True), [(None, f"{archive}-{seq}", None), *pending], strict=True):
                members.append(gzip.compress(convert(r, page, refers), 6, mtime=0))
            row = pa.RecordBatch.from_arrays([pa.array([archive], pa.int32()), pa.array([seq], pa.int32()), pa.array([b"".join(members)], pa.binary())], ["archive", "seq", "data"])
            seq, held = seq + 1, 0
            pending.clear()
            return row

        for b in batches:
            ids, urls, payloads, firsts, first_urls = (b.column(i) for i in range(5))
            for i in range(b.num_rows):
                page, url, payload, first_id = ids[i].as_py(), _clean(urls[i].as_py()), payloads[i].as_py(), firsts[i].as_py()
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                refers = None if first_id is None or first_id == page else (first_id, _clean(first_urls[i].as_py()), _date(first_id))
                pending.append((ArcRecord(url, "0.0.0.0", _date(page), "text/html", "200", body), page, refers))
                held += len(body)
                if held >= SEGMENT_BYTES:
                    yield segment()
        if pending:
            yield segment()

    linked.mapInArrow(pack, SEGMENT).write.option("compression", "uncompressed").parquet(out)
    return Archive(spark, out)


def convert_files(spark: SparkSession, source: str, path: str | None = None) -> Archive:
    """Convert the ``.arc`` and ``.arc.gz`` files below ``source``, on any store that Spark reads.

    A file is read whole, as one task's row, so it has to be below 2 GB (the format's own files are
    of 100 MB). Its records keep its name as place; equal payloads are not linked.
    """
    out = path or scratch(spark, "warc")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                members: list[bytes] = []
                held = 0
                for k, r in enumerate(parse_arc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, block=True)):
                    members.append(gzip.compress(convert(r, None, None, f"{name}#{k}"), 6, mtime=0))
                    held += len(members[-1])
                    if held >= SEGMENT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([archive], pa.int32()), pa.array([seq], pa.int32()), pa.array([b"".join(members)], pa.binary())], ["archive", "seq", "data"])
                        seq, held = seq + 1, 0
                        members.clear()
                if members:
                    yield pa.RecordBatch.from_arrays([pa.array([archive], pa.int32()), pa.array([seq], pa.int32()), pa.array([b"".join(members)], pa.binary())], ["archive", "seq", "data"])
                    seq += 1

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc{,.gz}").option("recursiveFileLookup", "true").load(source)
    files.select("path", "content").mapInArrow(pack, SEGMENT).write.option("compression", "uncompressed").parquet(out)
    return Archive(spark, out)


def export(archive: Archive, folder: str) -> list[str]:
    """Write each archive as ``<folder>/<archive>.warc.gz``, segment by segment, on the driver's disk."""
    import os

    os.makedirs(folder, exist_ok=True)
    files: list[str] = []
    for row in archive.segments().orderBy("archive", "seq").toLocalIterator():
        name = f"{folder}/{row['archive']:05d}.warc.gz"
        with open(name, "ab" if name in files else "wb") as f:
            f.write(row["data"])
        if name not in files:
            files.append(name)
    return files


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
d AS (SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((('0x' || substr(x, (5 * (j // 4) + 1)::BIGINT, 5))::INTEGER >> (15 - 5 * (j % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest
      FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id OR page_id IS NULL AND first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
