"""ARC archives to WARC archives.

An ARC file is a version block followed by records, each a header line and as many bytes as that line declares. Version 1
lines have five fields (URL, IP address, date, content type, length), version 2 lines ten. The version block of
either is a record itself and names the version and the fields. The converter walks a file by declared lengths only, so bodies
may hold anything, also what looks like a header; and gives each record the WARC header with the same content: an identifier made
from the record's content and place, the ISO timestamp, the type, block and payload digests. A payload seen before
becomes a ``revisit`` without body, which names the first's record, target and date. A ``warcinfo`` record opens each WARC file.

ARC and WARC files are gzip streams of whole records (one stream a file: Spark's writers compress files, not records). Both are cut by bytes:
records are packed to about ``PACK_BYTES`` (one record at least), so a file, and the row that holds it, is bounded by that or by its largest
record. Which record a revisit refers to is joined by page and digest, so that copies of one payload do not meet in one task.

Cases: null html is an empty payload; null or blank urls are written as ``-`` and white space in them as %XX; a null id is
written as such and reads back null; rows with equal id and payload share their verdict; pages of which all ids are null
are all responses; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.workspace import hot_rows, join_by, small_side, Workspace

PACK_BYTES = 4 << 20
FIELDS_1 = b"URL IP-address Archive-date Content-type Archive-length"
FIELDS_2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
ADDRESS = b"0.0.0.0"
DATE = b"20240101000000"


class ArcRecord(NamedTuple):
    url: bytes
    address: bytes
    date: bytes
    media: bytes
    body: bytes


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC ---------------------------------------------------------------------------------------------------------


def arc_version_block(version: int, name: bytes = b"pages.arc") -> bytes:
    """The version block that opens an ARC file."""
    body = b"%d %d quillspark\n%s\n" % (version, version == 2, FIELDS_2 if version == 2 else FIELDS_1)
    head = b"filedesc://%s %s %s text/plain " % (name, ADDRESS, DATE)
    return head + (b"200 - - 0 %s %d\n" % (name, len(body)) if version == 2 else b"%d\n" % len(body)) + body + b"\n"


def arc_record(version: int, url: bytes, media: bytes, body: bytes, offset: int) -> bytes:
    head = b"%s %s %s %s " % (url, ADDRESS, DATE, media)
    return head + (b"200 %s - %d pages.arc %d\n" % (base32_sha1(body).encode(), offset, len(body)) if version == 2 else b"%d\n" % len(body)) + body + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block left out. Raises ValueError where a line or length doesn't fit."""
    at, fields = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # separators
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"unended header line at {at}")
        line = data[at:end].rstrip(b"\r").split(b" ")
        opening = line[0].startswith(b"filedesc://")
        if not opening and len(line) != fields:
            raise ValueError(f"{len(line)} fields at {at}, {fields} expected")
        length = int(line[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"{length} bytes declared at {at}, {len(body)} left")
        if opening:
            version = body.split(b" ", 1)[0]
            fields = {b"1": 5, b"2": 10}.get(version, 0)
            if not fields:
                raise ValueError(f"unknown ARC version {version!r}")
        else:
            yield ArcRecord(line[0], line[1], line[2], line[3], body)
        at = end + 1 + length


# --- WARC --------------------------------------------------------------------------------------------------------


def record_id(*parts: bytes) -> bytes:
    """A name-based UUID of the parts, as WARC-Record-ID."""
    digest = hashlib.sha256(b"\0".join(parts)).digest()[:16]
    return b"<urn:uuid:%s>" % str(uuid.UUID(bytes=digest, version=5)).encode()


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with its empty line, and payload; a body without head is all payload."""
    end = body.find(b"\r\n\r\n")
    return (body[: end + 4], body[end + 4 :]) if body.startswith(b"HTTP/") and end >= 0 else (b"", body)


def iso_date(date: bytes) -> bytes:
    d = date.decode().ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z".encode()


class First(NamedTuple):
    """The response that a revisit refers to."""

    page: bytes
    url: bytes
    date: bytes


def warcinfo(name: bytes) -> bytes:
    """The record that opens a WARC file."""
    block = b"software: quillspark\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC\r\n"
    head = [b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Record-ID: " + record_id(b"warcinfo", name), b"WARC-Date: " + iso_date(DATE), b"Content-Type: application/warc-fields"]
    return b"\r\n".join([*head, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_record(arc: ArcRecord, page: bytes, first: First | None) -> bytes:
    """The WARC record equivalent to an ARC record; ``first``: the response that has the same payload, if this one is a revisit."""
    http, payload = split_http(arc.body)
    digest = base32_sha1(payload).encode()
    block = http if first is not None else arc.body
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if first is not None else b"response"),
        b"WARC-Record-ID: " + record_id(arc.url, arc.date, page, digest),
        b"WARC-Target-URI: " + arc.url,
        b"WARC-IP-Address: " + arc.address,
        b"WARC-Date: " + iso_date(arc.date),
        b"WARC-Payload-Digest: sha1:" + digest,
        b"WARC-Block-Digest: sha1:" + base32_sha1(block).encode(),
        b"Content-Type: " + (b"application/http;msgtype=response" if http else arc.media),
        b"X-Page: " + page,
        b"X-Payload-Length: %d" % len(payload),
    ]
    if first is not None:
        lines += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To: " + record_id(first.url, first.date, first.page, digest),
            b"WARC-Refers-To-Target-URI: " + first.url,
            b"WARC-Refers-To-Date: " + iso_date(first.date),
            b"X-Refers-To-Page: " + first.page,
        ]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields (names in lower case) and block of each record, walked by Content-Length."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC header at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in data[at:end].split(b"\r\n")[1:])}
        length = int(fields[b"content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ValueError(f"{length} bytes declared at {at}, {len(block)} left")
        yield fields, block
        at = end + 4 + length


# --- Spark -------------------------------------------------------------------------------------------------------

_SPACES = re.compile(rb"[\x00-\x20\x7f]")


def _url(value: str | None) -> bytes:
    raw = (value or "").encode()
    return _SPACES.sub(lambda m: b"%%%02X" % m[0][0], raw) or b"-"


def _pack_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to archives of about PACK_BYTES, of either version in turn."""
    parts: list[bytes] = []
    size, turn = 0, 0
    out = lambda: pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(parts)], pa.binary())})
    for batch in batches:
        for page, url, html in zip(*(batch.column(k) for k in ("page_id", "url", "html"))):
            payload = (html.as_py() or "").encode()
            if not parts:
                turn += 1
                parts.append(arc_version_block(1 + turn % 2))
                size = len(parts[0])
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page: %s\r\n\r\n" % (b"-" if page.as_py() is None else b"%d" % page.as_py())
            parts.append(arc_record(1 + turn % 2, _url(url.as_py()), b"text/html", head + payload, size))
            size += len(parts[-1])
            if size >= PACK_BYTES:
                yield out()
                parts = []
    if parts:
        yield out()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, ArcRecord]]:
    import gzip

    for batch in batches:
        for content in batch.column("content"):
            for arc in read_arc(gzip.decompress(content.as_py())):
                http, _ = split_http(arc.body)
                at = http.find(b"\r\nX-Page: ")
                yield http[at + 10 : http.find(b"\r\n", at + 2)] if at >= 0 else b"-", arc


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for page, arc in _records(batches):
        rows.append((None if page == b"-" else int(page), base32_sha1(split_http(arc.body)[1]), arc.url, arc.date))
        if len(rows) >= 10_000:
            yield _table(rows)
            rows = []
    if rows:
        yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "digest", "url", "date"])


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ARC records that joined their first, to WARC files without their last line feed, which the writer adds."""
    parts: list[bytes] = []
    size = 0

    def out() -> pa.RecordBatch:
        whole = b"".join([warcinfo(hashlib.sha256(parts[0]).digest()), *parts])
        return pa.RecordBatch.from_pydict({"archive": pa.array([whole[:-1]], pa.binary())})

    for batch in batches:
        for url, address, date, media, body, page, first, first_url, first_date in zip(*batch.columns):
            own = b"-" if page.as_py() is None else b"%d" % page.as_py()
            refers = None if first.as_py() is None else First(b"%d" % first.as_py(), first_url.as_py(), first_date.as_py())
            parts.append(warc_record(ArcRecord(url.as_py(), address.as_py(), date.as_py(), media.as_py(), body.as_py()), own, refers))
            size += len(parts[-1])
            if size >= PACK_BYTES:
                yield out()
                parts, size = [], 0
    if parts:
        yield out()


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        kinds = [pa.binary()] * 5 + [pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["url", "address", "date", "media", "body", "page_id", "digest"])

    for page, arc in _records(batches):
        rows.append((*arc, None if page == b"-" else int(page), base32_sha1(split_http(arc.body)[1])))
        size += len(arc.body)
        if size >= PACK_BYTES:
            yield out()
            rows, size = [], 0
    if rows:
        yield out()


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for f, block in read_warc(gzip.decompress(content.as_py())):
                kind = f[b"warc-type"].decode()
                if kind == "warcinfo":
                    continue
                digest = f[b"warc-payload-digest"].decode().partition(":")[2]
                if kind == "response" and base32_sha1(split_http(block)[1]) != digest:
                    raise ValueError(f"payload of {f[b'warc-record-id']!r} does not fit its digest")
                page, first = f[b"x-page"], f.get(b"x-refers-to-page")
                rows.append((None if page == b"-" else int(page), int(f[b"x-payload-length"]), digest, kind, None if first is None else int(first)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def write_arc(pages: DataFrame, path: str) -> None:
    """Packs pages (page_id, url, html) into ARC files under ``path``, one archive a file."""
    packed = pages.select("page_id", "url", "html").mapInArrow(_pack_arc, "archive binary")
    # The writer ends each row by a line feed, a separator between ARC records.
    packed.select(F.col("archive").cast("string")).write.option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, work: Workspace) -> None:
    """Converts all ARC files under a path. Payloads met twice or more are found first, by digest and smallest page."""
    arcs = spark.read.format("binaryFile").load(arc_path).select("content")
    seen = work.keep(arcs.mapInArrow(_digests, "page_id long, digest string, url binary, date binary"), "seen")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date"))).alias("first")
    firsts = seen.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    firsts = work.keep(firsts, "firsts")
    hot = firsts.where(F.col("n") > hot_rows(seen.count())).select("digest")
    later = join_by(seen, firsts.select("digest", "first"), "digest", None if hot.isEmpty() else hot).where("page_id != first.page_id").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date"))
    later = small_side(work.keep(later.distinct(), "later"))
    records = arcs.mapInArrow(_explode, "url binary, address binary, date binary, media binary, body binary, page_id long, digest string")
    joined = records.join(later, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    packed = joined.select("url", "address", "date", "media", "body", "page_id", "first", "first_url", "first_date").mapInArrow(_convert, "archive binary")
    packed.select(F.col("archive").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", 1).text(warc_path)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read_back, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """ARC files from ``pages``, converted to WARC and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    write_arc(pages, work.path("arc"))
    arc_to_warc(spark, work.path("arc"), work.path("warc"), work)
    work.drop("arc", "seen", "firsts", "later")
    return read_warc_files(spark, work.path("warc"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP9_SQL = r"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
named AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(8), lambda i:
    list_aggregate(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::BIGINT >> s) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM named)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM firsts
"""
