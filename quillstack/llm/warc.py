"""WARC archives: writing with revisits and segments, and reading with segment reassembly.

Writing: equal payloads become one response and revisits. Record blocks (HTTP with chunked framing) longer than a
segment go on in continuation records. Each record is a gzip member, and archives of bounded size are the rows
that Spark's own writer commits. Reading: continuation records are grouped by the identifier of their origin,
ordered by segment number, checked against the total length, and the chunked framing is decoded.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import materialise

ARCHIVE = 16 << 20
SEGMENT = 64 << 10
CHUNK = 16 << 10
LEAST = 100
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "origin string, segment int, total long, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, error string"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Undo chunked framing; raises ValueError if it is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter or longer than it says")
        out.append(body[at:at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, segment: int) -> Iterator[bytes]:
    """The WARC records of one page: a revisit, or a response with its continuations."""
    name = f"<urn:uuid:{uuid.uuid4()}>"
    common: list[tuple[str, object]] = [("WARC-Date", DATE)]
    if url is not None:
        common.append(("WARC-Target-URI", re.sub(r"[\r\n]+", "%0D%0A", url)))
    own: list[tuple[str, object]] = [("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)),
                                     ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        own.append(("X-Page-ID", page_id))
    if is_revisit:
        yield record([("WARC-Type", "revisit"), ("WARC-Profile", REVISIT), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", refers_to), *own], HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *own], block)
        return
    yield record([("WARC-Type", "response"), ("WARC-Segment-Number", 1), *own], block[:segment])
    for n, at in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", len(block))] if at + segment >= len(block) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common,
                      ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), *last], block[at:at + segment])


def first_pages(pages: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(digest, first): the smallest page of each payload of at least ``least`` bytes that several rows have."""
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    meta = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    return meta.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null").select("digest", "first")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
                   least: int = LEAST, segment: int = SEGMENT, archive: int = ARCHIVE) -> None:
    """Write a record per row to archives under ``path``, each at most about ``archive`` bytes before compression.

    A null payload is empty. Rows whose payload has ``least`` bytes or more and is also another row's are revisits of
    the smallest page id with that payload; rows that have that very id are responses. The first ids are joined on the
    digest, so a payload that very many rows share is a skewed join, which adaptive execution splits.
    """
    first = materialise(first_pages(pages, id_col, text_col, least), "first_pages")
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    rows = rows.join(first, "digest", "left")
    rows = rows.select("id", "url", "digest", "first", F.expr("first is not null and not (id <=> first)").alias("is_revisit"), "payload")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, digest, first_id, is_revisit, body = (c[i].as_py() for c in b.columns)
                for r in records(page_id, url, body, digest, first_id, is_revisit, segment):
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    held.append(pack.compress(r) + pack.flush())
                    size += len(r)
                if size >= archive:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    # One archive a row and file. Readers of gzip skip zero bytes at the end.
    rows.mapInArrow(build, "archive binary").select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(bytes, error) of each gzip member, in one pass; a broken one has what could be read. Data that isn't gzip is one member."""
    at, magic = 0, b"\x1f\x8b\x08"
    if not data.startswith(magic):
        yield data, None
        return
    while at < len(data):
        if not data.startswith(magic, at):
            after = data.find(magic, at)
            if data[at:after if after >= 0 else len(data)].strip(b"\0"):  # zeros between or after members mean nothing
                yield b"", "bytes that no archive member has"
            if after < 0:
                return
            at = after
        unpack, out, read = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof and read < len(data):
                out.append(unpack.decompress(data[read:read + (1 << 16)]))
                read += 1 << 16
        except zlib.error as e:
            yield b"".join(out), str(e)
            at = data.find(magic, at + 1)
            if at < 0:
                return
            continue
        yield b"".join(out), None if unpack.eof else "an archive member is cut off"
        at = min(read, len(data)) - len(unpack.unused_data)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers with lower-case names, block, error) of each record; after a broken one, on with the next line that begins a record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        headers, error, size = {}, None, 0
        if end < 0 or not data.startswith(b"WARC/", at):
            error, end = "a record has no header", at
        else:
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines) if colon}
            length = headers.get("content-length", "")
            if not length.isdecimal():
                error = "a record doesn't say its length"
            else:
                size, end = int(length), end + 4
                if data[end + size:end + size + 4] != b"\r\n\r\n":
                    error = "a block is shorter or longer than its header says"
        yield headers, data[end:end + size] if error is None else b"", error
        if error is None:
            at = end + size + 4
        else:
            at = data.find(b"\r\nWARC/", max(at, 1))
            if at < 0:
                return
            at += 2


def body_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?i)transfer-encoding:\s*chunked", head) else body


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _parsed(data: bytes) -> Iterator[tuple]:
    for h, block, error in parse(data):
        kind, payload = h.get("warc-type"), block
        try:
            segment, total = _number(h.get("warc-segment-number")), _number(h.get("warc-segment-total-length"))
            page, refers, length = _number(h.get("x-page-id")), _number(h.get("x-refers-to-page-id")), _number(h.get("x-payload-length"))
        except ValueError as e:
            segment = total = page = refers = length = None
            error = error or str(e)
        if error:
            segment, payload = None, None
        elif segment is None:
            try:
                payload = None if kind == "revisit" else body_of(block)
            except ValueError as e:
                payload, error = None, str(e)
        yield (h.get("warc-segment-origin-id", h.get("warc-record-id")), segment, total, page, kind, refers, h.get("warc-payload-digest", "").rpartition(":")[2] or None, length, payload, error)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PARSED.split(", ")])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column(0):
            held, size = [], 0
            for whole, broken in members(data.as_py()):
                found = list(_parsed(whole))
                if broken:  # what its last record says can't be trusted
                    found = [*found[:-1], (*((found[-1] if found else (None,) * 10)[:8]), None, broken)]
                    found[-1] = (found[-1][0], None, *found[-1][2:])
                for row in found:
                    held.append(row)
                    size += len(row[8] or b"")
                if size > 4 << 20:
                    yield _rows(held)
                    held, size = [], 0
            yield _rows(held)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            parts = [(p["segment"], p["payload"]) for p in r["parts"]]  # in the order of segment numbers
            block, payload, error = b"".join(p for _, p in parts), None, None
            if [n for n, _ in parts] != list(range(1, len(parts) + 1)):
                error = "a segment is missing or twice there"
            elif r["total"] != len(block):
                error = "the segments don't have the total length"
            else:
                try:
                    payload = body_of(block)
                except ValueError as e:
                    error = str(e)
            out.append((r["origin"], None, r["total"], r["page_id"], "response", None, r["payload_digest"], r["payload_bytes"], payload, error))
        yield _rows(out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per page record: page_id, record_type, refers_to, payload_digest and payload_bytes as its header says,
    payload (null for revisits and broken records), error (null if whole).

    A record or an archive member that is broken is a row with an error, and reading goes on after it. Foreign archives
    without the X- headers have null page ids and lengths. Records in one piece are decoded where they are read; only segments are shuffled, and a group is one payload.
    """
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, PARSED)
    names = [x.split()[0] for x in PARSED.split(", ")]
    split = found.where("segment is not null").groupBy("origin").agg(
        F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("payload_digest").alias("payload_digest"), F.max("payload_bytes").alias("payload_bytes"),
        F.sort_array(F.collect_list(F.struct("segment", "payload"))).alias("parts")).mapInArrow(_reassemble, PARSED)
    return found.where("segment is null").select(names).union(split).drop("origin", "segment", "total")


def round_trip(pages: DataFrame, path: str, **options) -> DataFrame:
    """Write the pages' archives to ``path`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, error.

    Length and digest come from the reassembled payload, for revisits from their record. An empty table gives no rows;
    null page ids stay null; repeated rows each have their record; other columns are not read.
    """
    write_archives(pages, path, **options)
    back = read_archives(pages.sparkSession, path)
    whole = F.col("payload").isNotNull()
    return back.select("page_id", F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                       F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to", "error")


def oracle() -> str:
    """The same in DuckDB SQL."""
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= {LEAST} GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN f ON p.digest = f.digest"""
