"""WARC: archives are written and read with segmented records and chunked transfer framing.

Writing: a page becomes an HTTP response with chunked framing; a block over SEGMENT bytes is cut into a first record and
continuation records, the last of which tells the total length. Pages whose payload occurs on a page with a smaller id are
revisit records. Each record is a gzip member of its own, as archives' readers expect, so one can be read from its offset.
Spark's text writer lays the members down, so files are committed as any other output, in any file system; as it needs
something between its lines, that is an empty member, which adds no byte to what is read.

Reading: plain archives and gzip files of any number of members are parsed record by record by Content-Length; continuation records are grouped by the identifier
of their origin, ordered by segment number, checked against the total length, and freed of the chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm.tables import place, table, written

SEGMENT = 8192
CHUNK = 4096
#: An archive has so many records at most, so it is 34 MB at most before compression, and one is read at a time.
RECORDS = 4096
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
LAST = (1 << 63) - 1
_END = b"\r\n\r\n"
#: A fixed level, and no time of day in the member's head: equal records give equal members.
LEVEL = 6
#: Compressed bytes inflated at a time.
_STEP = 1 << 14


def member(data: bytes) -> bytes:
    """A gzip member."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


#: Between members. The writer takes a string, in an encoding that has each byte as a character.
_BETWEEN = member(b"").decode("latin-1")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for i in range(0, len(payload), size) if (part := payload[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body. Raises ValueError for broken framing."""
    at, parts = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where it should")
        parts.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record with the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END


def _urn(page: int, row: int) -> str:
    return f"<urn:riskgrid:page:{'' if page == LAST else page}:{row}>"


def page_records(page: int, row: int, url: str, payload: bytes, origin: int | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of a page: a revisit of the page ``origin``, or a response and its continuations."""
    known = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    own = [("WARC-Record-ID", _urn(page, row)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url.replace("\r", "").replace("\n", "")), ("WARC-Payload-Digest", f"sha1:{known}")]
    if origin is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:riskgrid:page:{origin}>"), ("Content-Type", "application/http;msgtype=response")]
        return [_record([("WARC-Type", "revisit"), *own, *more], http + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), *own, ("Content-Type", "application/http;msgtype=response")]
    if len(parts) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{_urn(page, row)[:-1]}:{n}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", _urn(page, row)), ("WARC-Segment-Number", n)]
        out.append(_record([*head, ("WARC-Segment-Total-Length", len(block))] if n == len(parts) else head, part))
    return out


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Archives of the pages (page_id, url, html) in the folder ``path``: files of WARC records, each a gzip member.

    A null html is an empty payload, a null url an empty one. Of pages with equal payloads of ``least`` bytes or more, those
    with the smallest page_id are responses, the others revisits; a null page_id comes after all others. Rows that repeat a
    page are records of their own, of the same type. A payload may be of any length; columns other than the three, whatever
    their names, aren't read.
    """
    base = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(LAST)).alias("page"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    key = [F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")]
    first = base.select("page", *key).where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # As a written table the revisits have a known size: where they are few, Spark broadcasts them and no payload is shuffled.
    revisits = written(base.select("page", *key).join(first, ["sha", "size"]).where("page > first").select("page", "sha", "size", "first").distinct(), "revisits")
    marked = base.select("*", *key).join(revisits, ["page", "sha", "size"], "left").select("page", F.monotonically_increasing_id().alias("row"), "url", "payload", "first")

    def run(batches):
        for batch in batches:
            out: list[bytes] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += map(member, page_records(*row))
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("encoding", "ISO-8859-1").option("lineSep", _BETWEEN).option("maxRecordsPerFile", RECORDS).text(path)


def inflated(content) -> bytes:
    """The bytes of an archive: of all its gzip members, or as they are. Raises zlib.error or ValueError for a broken member."""
    content = memoryview(content).cast("B")
    if bytes(content[:2]) != b"\x1f\x8b":
        return bytes(content)
    out, at = [], 0
    while at < len(content):
        stream = zlib.decompressobj(31)
        while not stream.eof:
            if at >= len(content):
                raise ValueError("a gzip member ends early")
            out.append(stream.decompress(content[at : at + _STEP]))
            at = min(len(content), at + _STEP)
        at -= len(stream.unused_data)
    return b"".join(out)


def parse(archive: bytes):
    """(headers, block) of each record of an archive. Raises ValueError where a record doesn't end as it should."""
    at = 0
    while at < len(archive):
        head = archive.index(b"\r\n\r\n", at)
        lines = archive[at:head].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC record here")
        headers = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, v in (line.split(b":", 1) for line in lines[1:])}
        begin = head + 4
        end = begin + int(headers["content-length"])
        if archive[end : end + 4] != _END:
            raise ValueError("a record doesn't end with two line ends")
        yield headers, archive[begin:end]
        at = end + 4


def segments(spark: SparkSession, path: str) -> DataFrame:
    """origin, number, total, type, page, digest, refers, block: the records of the archives, plain or gzip, in a folder."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = ["origin", "number", "total", "type", "page", "digest", "refers", "block"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for h, block in parse(inflated(content.as_buffer())):
                    origin = h.get("warc-segment-origin-id", h.get("warc-record-id"))
                    total = h.get("warc-segment-total-length")
                    rows.append((origin, int(h.get("warc-segment-number", 1)), int(total) if total else None, h["warc-type"], origin.split(":")[3], h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h["warc-refers-to"].strip("<>").split(":")[3] if "warc-refers-to" in h else None, block))
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, "origin string, number int, total long, type string, page string, digest string, refers string, block binary")


def reassemble(parts: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The block of a record from its segments. Raises ValueError for missing or repeated segments or a wrong total length."""
    parts = sorted(parts, key=lambda p: p[0])
    if [n for n, _ in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(b for _, b in parts)
    if (total is None) != (len(parts) == 1) or total not in (None, len(block)):
        raise ValueError("the total length doesn't match")
    return block


def payload_of(block: bytes) -> tuple[bytes | None, int]:
    """The payload of an HTTP response and its length; a response without a body tells the length alone."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, v in (line.split(b":", 1) for line in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        payload = dechunked(body)
        return payload, len(payload)
    return None, int(fields[b"content-length"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of each page in the archives.

    A page's segments are bounded by its own size; they meet wherever the archives hold them. Broken records raise.
    """
    records = segments(spark, path)
    grouped = records.groupBy("origin").agg(F.max("total").alias("total"), F.max(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"), F.max("page").alias("page"), F.max("digest").alias("digest"), F.max("refers").alias("refers"), F.collect_list(F.struct("number", "block")).alias("parts"))

    def run(batches):
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                total, kind, page, known, refers, parts = (batch.column(c)[k].as_py() for c in range(6))
                payload, size = payload_of(reassemble([(p["number"], p["block"]) for p in parts], total))
                if payload is not None and digest(payload) != known:
                    raise ValueError(f"the payload of page {page} has another digest than its record tells")
                rows.append((int(page) if page else None, payload, size, known, kind, int(refers) if refers else None))
                if len(rows) >= 512:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return grouped.drop("origin").mapInArrow(run, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of the pages, written to the shared folder and read back; no row for an empty table."""
    path = place(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read(spark, path).drop("payload")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, strlen(html) AS n, (unhex(sha1(html))::BIT)::VARCHAR AS bits, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
    + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM q
"""
