"""WARC archives: pages written as segmented, chunk-framed records, and read back by reassembly.

Writing: a page is a response record whose block is an HTTP message with a chunked body. A block longer than a segment
is cut: the first part stays a response with ``WARC-Segment-Number: 1``, the others are continuation records that name it.
A page whose payload an earlier page has is a revisit record that refers to that page.

Reading: continuation records are grouped by the identifier of their origin, put in order of segment number, checked
against the total length, and the chunked framing is taken off.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaportrail.session import new_stage_path, stage

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT = 64 << 10  # bytes of block in one record
CHUNK = 16 << 10  # characters of body in one chunk
RECORDS = 1000  # in one file, so a file holds at most RECORDS * (SEGMENT + headers) bytes when unpacked
MIN_PAYLOAD = 0  # bytes from which equal payloads become revisits


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(fields: dict[str, object]) -> bytes:
    return b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields.items())


def _cuts(text: str, size: int) -> list[bytes]:
    """UTF-8 pieces of ``size`` characters: records stay readable text."""
    return [text[i : i + size].encode("utf-8", "replace") for i in range(0, len(text), size)]


def response_block(text: str) -> list[bytes]:
    """An HTTP response with a chunked body, in parts that may be cut between."""
    head = b"HTTP/1.1 200 OK" + CRLF + _headers({"Content-Type": "text/html; charset=utf-8", "Transfer-Encoding": "chunked"})
    chunks = [f"{len(c):x}".encode() + CRLF + c + CRLF for c in _cuts(text, CHUNK)]
    return [head + CRLF, *chunks, b"0" + CRLF + CRLF]


def page_records(page_id: int | None, url: str | None, text: str, refers_to: int | None, record_id: str) -> Iterator[bytes]:
    """The records of one page, each from its version line to the end of its block."""
    payload = text.encode("utf-8", "replace")
    common = {"WARC-Target-URI": (url or "").replace("\r", "").replace("\n", "")}
    if page_id is not None:
        common["X-Page-ID"] = page_id
    common["WARC-Payload-Digest"] = f"sha1:{payload_digest(payload)}"
    content = {"Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK" + CRLF + _headers({"Content-Length": len(payload)}) + CRLF
        own = {"WARC-Type": "revisit", "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Profile": PROFILE}
        fields = own | common | {"X-Refers-To-Page-ID": refers_to} | content | {"Content-Length": len(block)}
        yield b"WARC/1.1" + CRLF + _headers(fields) + CRLF + block
        return
    parts, segments = response_block(text), [[]]
    for part in parts:
        if segments[-1] and sum(map(len, segments[-1])) + len(part) > SEGMENT:
            segments.append([])
        segments[-1].append(part)
    total = sum(map(len, parts))
    for number, segment in enumerate(segments, 1):
        block = b"".join(segment)
        origin = f"<urn:uuid:{record_id}>"
        if number == 1:
            fields = {"WARC-Type": "response", "WARC-Record-ID": origin} | common | content
            fields |= {"WARC-Segment-Number": 1} if len(segments) > 1 else {}
        else:
            own = uuid.uuid5(uuid.UUID(record_id), str(number))
            fields = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{own}>", "WARC-Segment-Origin-ID": origin}
            fields["WARC-Segment-Number"] = number
            if number == len(segments):
                fields["WARC-Segment-Total-Length"] = total
        yield b"WARC/1.1" + CRLF + _headers(fields | {"Content-Length": len(block)}) + CRLF + block


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Writes ``pages`` (page_id, url, html) as gzipped WARC files.

    Which page is the first with its payload is found on digests alone; only pages that are revisits are joined back to
    the texts. Files are written by Spark's committer: a task that is lost leaves no part behind.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")))
    keyed = stage(
        pages.select("page_id", digest.alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")), "warc-digests"
    )
    shared = keyed.where((F.col("n") >= min_payload) & F.col("page_id").isNotNull())
    firsts = (
        shared.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    )
    revisits = stage(
        shared.join(firsts, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct(),
        "warc-revisits",
    )
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), digest.alias("digest"))
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to", F.expr("uuid()").alias("rid"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                made = [r.decode() + "\r\n" for r in page_records(*(x.as_py() for x in row))]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])

    writer = rows.mapInArrow(records, "value string").write.option("maxRecordsPerFile", RECORDS)
    # a record ends with two line ends: one is part of its row, the other is the writer's
    writer.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of an archive, whose blocks are taken by their stated length."""
    at = 0
    while True:
        while data[at : at + 2] == CRLF:
            at += 2
        if at >= len(data):
            return
        end = data.index(CRLF + CRLF, at)
        lines = data[at:end].split(CRLF)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
        start, length = end + 4, int(headers["content-length"])
        if start + length > len(data):
            raise ValueError("archive ends inside a record")
        yield headers, data[start : start + length]
        at = start + length


def unpack(content: bytes) -> bytes:
    """An archive's records, whether it is plain, gzipped whole, or one gzip member for each record."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts)


def dechunk(body: bytes) -> bytes | None:
    """The entity of a chunked body, or None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(parts)
        if body[end + 2 + size : end + 4 + size] != CRLF:
            return None
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def http_entity(block: bytes) -> tuple[dict[str, str], bytes | None]:
    head, _, body = block.partition(CRLF + CRLF)
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("latin-1").partition(":") for x in head.split(CRLF)[1:])}
    return headers, dechunk(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


_RECORD = "origin string, segment int, total long, kind string, url string, page_id long, refers_to long, digest string, block binary, n long"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. Whole responses are decoded where they are read; only segments keep their block."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = [x.split()[0] for x in _RECORD.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]

    def rows(content: bytes) -> Iterator[tuple]:
        number = lambda x: int(x) if x is not None else None
        for h, block in parse_records(unpack(content)):
            kind, segment = h["warc-type"], int(h.get("warc-segment-number", 0))
            origin = h.get("warc-segment-origin-id", h["warc-record-id"])
            digest, n = h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
            if kind == "revisit":
                n, block = number(http_entity(block)[0].get("content-length")), None
            elif segment == 0:
                entity = http_entity(block)[1]
                digest, n, block = (payload_digest(entity), len(entity), None) if entity is not None else (None, None, None)
            yield (
                origin,
                segment,
                number(h.get("warc-segment-total-length")),
                kind,
                h.get("warc-target-uri"),
                number(h.get("x-page-id")),
                number(h.get("x-refers-to-page-id")),
                digest,
                block,
                n,
            )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in rows(content.as_py()):
                    held.append(row)
                    size += len(row[8] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(read, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """(page_id, url, kind, payload_bytes, payload_digest, refers_to, complete) of every page.

    Segments of one origin meet by its identifier; a group is one page. ``complete`` is false, and the payload null, if
    segments are missing, do not add up to the stated total, or carry broken framing.
    """
    whole = records.where("segment = 0").select(
        "page_id", "url", "kind", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "refers_to"
    )
    segments = (
        records.where("segment > 0")
        .groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
            F.max("total").alias("total"),
            *[F.max(c).alias(c) for c in ("page_id", "url")],
        )
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for parts, total in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                parts = parts.as_py()
                block = b"".join(p["block"] for p in parts)
                in_order = [p["segment"] for p in parts] == list(range(1, len(parts) + 1))
                entity = http_entity(block)[1] if in_order and len(block) == total else None
                sizes.append(None if entity is None else len(entity))
                digests.append(None if entity is None else payload_digest(entity))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "payload_bytes", "payload_digest"])

    joined = segments.select("page_id", "url", "parts", "total").mapInArrow(
        join, "page_id long, url string, payload_bytes long, payload_digest string"
    )
    joined = joined.select(
        "page_id", "url", F.lit("response").alias("kind"), "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to")
    )
    return whole.unionByName(joined).withColumn("complete", F.col("payload_bytes").isNotNull())


def archive_round_trip(
    pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Writes all pages as archives under ``path`` (a new shared folder if none), reads them back and reassembles them.

    Null html is an empty payload, which counts among equal payloads. Pages without id are responses. Rows that repeat an
    id and its payload are each written; of one payload all rows with the smallest id are responses. An empty table gives
    no row. Other columns are ignored. Payloads of any length are cut into segments.
    """
    spark = pages.sparkSession
    path = path or new_stage_path(spark, "warc")
    named = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    write_archives(named, path)
    records = stage(read_records(spark, path), "warc-records")
    return reassemble(records)


def record_type(kind: Column) -> Column:
    return F.when(kind == "revisit", kind).otherwise("response")
