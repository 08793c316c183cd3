"""WARC archives: writing with deduplication and segmentation, reading with segment reassembly.

Writing. One record per page. Of equal payloads the page with the smallest id is a ``response`` record, whose HTTP
body is in chunked transfer framing; the others are ``revisit`` records that refer to it. A block longer than
``SEGMENT_BYTES`` is cut: the first part keeps the record's type, the rest follows in ``continuation`` records
(WARC-Segment-Origin-ID, WARC-Segment-Number, and WARC-Segment-Total-Length on the last). Records go to gzip
files by Spark's text writer, whose line separator is the blank lines that end a WARC record.

Reading. Records are parsed by their Content-Length. Whole ones are decoded where they are read; segments are grouped by
the identifier of their origin, ordered by number, verified (numbers 1 to n, total length) and decoded. A record
that fails a check, or whose payload does not have the digest it names, comes out with complete = false and no payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricefold.llm.common import scratch_path

SEGMENT_BYTES = 65_536
CHUNK_BYTES = 8_192
RECORDS_PER_FILE = 8_000
RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, complete boolean, payload string"
PART = "origin string, number int, total long, head string, block binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four groups of ten hex digits are eight base-32 digits each."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(head: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%X\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = re.fullmatch(rb"([0-9A-Fa-f]+)(;.*)?", body[at:line]) if line >= 0 else None
        if not size:
            return None
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out) if body[line:].endswith(b"\r\n\r\n") else None
        part = body[line + 2 : line + 2 + n]
        if len(part) < n or body[line + 2 + n : line + 4 + n] != b"\r\n":
            return None
        out.append(part)
        at = line + 4 + n


def records_of(page_id, url, payload: bytes, digest: str, refers_to, unique: str, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The WARC records (without their final blank lines) of one page."""
    name = f"urn:pricefold:page:{'' if page_id is None else page_id}"
    url = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}#{unique}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url)]
    head += [("X-Page-ID", page_id), ("X-Payload-Length", len(payload)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:pricefold:page:{refers_to}>"), ("X-Refers-To-Page-ID", refers_to)]
        return [_record(head, http + b"\r\n")]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [_record(head, block)]
    out = [_record([*head, ("WARC-Segment-Number", 1)], block[:segment])]
    for n, at in enumerate(range(segment, len(block), segment), 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}#{unique}.{n}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", f"<{name}#{unique}>"), ("WARC-Segment-Number", n)]
        own += [("WARC-Segment-Total-Length", len(block))] if at + segment >= len(block) else []
        out.append(_record(own, block[at : at + segment]))
    return out


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the smallest page_id with an equal payload, null on
    that page itself, on payloads below ``least_bytes`` and where no page of the group has an id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    firsts = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) to WARC files in the folder ``path``.

    A null html is an empty payload; null urls leave their header out; a null page_id is an empty id, a revisit where a page
    with an id has the same payload and a response otherwise. Repeated rows are records of their own (equal ids are all
    responses or all revisits). Other columns are ignored; an empty table writes no record.
    """

    def written(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for page_id, url, payload, digest, refers in zip(*(b.column(i).to_pylist() for i in range(5))):
                out += records_of(page_id, url, payload, digest, refers, f"{part}-{n}")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = with_originals(pages, least_bytes).mapInArrow(written, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _inflated(content: bytes, step: int = 1 << 20):
    """The bytes of a (multi-member) gzip file, or of a plain one, in pieces."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest = memoryview(content)
    while len(rest):
        z = zlib.decompressobj(31)
        while not z.eof and len(rest):
            piece = z.decompress(bytes(rest[:step]))
            used = min(step, len(rest)) - len(z.unused_data)
            rest = rest[used:]
            yield piece
        if not z.eof:
            return


def parsed(content: bytes):
    """(headers, block) of each record of a file; a record that the file's end cuts off has a short block."""
    buf, at, pieces = bytearray(), 0, _inflated(content)

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del buf[:at]
        at = 0
        buf.extend(piece)
        return True

    while True:
        while (end := buf.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        lines = bytes(buf[at:end]).decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"]) if head.get("content-length", "").isdigit() else 0
        at = end + 4
        while len(buf) - at < n + 4:
            if not more():
                break
        yield head, bytes(buf[at : at + n])
        at += n
        while buf[at : at + 2] == b"\r\n":
            at += 2


def _decoded(head: dict, block: bytes, whole: bool) -> tuple:
    """One row of RECORD from the headers of the first segment and the joined block."""
    number = lambda k: int(head[k]) if re.fullmatch(r"-?\d+", head.get(k, "")) else None
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    kind, length = head.get("warc-type"), number("x-payload-length")
    if kind == "revisit":
        return number("x-page-id"), kind, number("x-refers-to-page-id"), head.get("warc-target-uri"), length, digest, whole, None
    http, _, body = block.partition(b"\r\n\r\n")
    payload = None
    if whole:
        payload = unchunked(body) if b"transfer-encoding: chunked" in http.lower() else body
    if payload is not None and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        payload = None
    ok = payload is not None
    return number("x-page-id"), kind, None, head.get("warc-target-uri"), len(payload) if ok else length, digest, ok, payload.decode("utf-8", "replace") if ok else None


def _rows(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)


_RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("complete", pa.bool_()), ("payload", pa.string())])
_PART = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("head", pa.string()), ("block", pa.binary())])


def _batched(rows, kind: pa.Schema, most: int = 500):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield _rows(held, kind)
            held = []
    if held:
        yield _rows(held, kind)


def _whole_records(batches):
    rows = (_decoded(h, b, len(b) == int(h.get("content-length", -1))) for x in batches for c in x.column("content") for h, b in parsed(c.as_py()) if "warc-segment-number" not in h and h.get("warc-type") in ("response", "revisit"))
    yield from _batched(rows, _RECORD)


def _segments(batches):
    def rows():
        for x in batches:
            for c in x.column("content"):
                for h, b in parsed(c.as_py()):
                    if h.get("warc-segment-number", "").isdigit():
                        total = h.get("warc-segment-total-length", "")
                        first = h.get("warc-type") != "continuation"
                        head = "\r\n".join(f"{k}: {v}" for k, v in h.items()) if first else None
                        yield h.get("warc-record-id" if first else "warc-segment-origin-id"), int(h["warc-segment-number"]), int(total) if total.isdigit() else None, head, b

    yield from _batched(rows(), _PART, 50)


def _reassembled(batches):
    def rows():
        for x in batches:
            for parts in x.column("parts"):
                parts = parts.as_py()
                total = [p["total"] for p in parts if p["total"] is not None]
                block = b"".join(p["block"] for p in parts)
                whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and total == [len(block)]
                head = dict(line.split(": ", 1) for line in (parts[0]["head"] or "").split("\r\n") if ": " in line)
                yield _decoded(head, block, whole)

    yield from _batched(rows(), _RECORD, 50)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per response and revisit record of the WARC files in ``path`` (columns: RECORD).

    payload is the decoded text of responses, null on revisits (they refer to theirs) and on records that are not complete.
    Only segments are shuffled; a group is one record. A folder without files gives an empty result.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    whole = files.mapInArrow(_whole_records, RECORD)
    parts = files.mapInArrow(_segments, PART)
    grouped = parts.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "head", "block"))).alias("parts"))
    return whole.unionByName(grouped.select("parts").mapInArrow(_reassembled, RECORD))


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read it back: see :func:`write_archive`, :func:`read_archive`."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, least_bytes)
    return read_archive(spark, path)
