"""WARC archives: written from pages, read back with segment reassembly.

A record holds an HTTP response in chunked transfer coding; one whose block is longer than segment_bytes goes on in
continuation records. Pages with equal payloads of some length are revisits of the one with the smallest page_id.
Archives are gzip files that Spark's text source writes and reads with the record separator as line end, so they may lie
in any store that Spark reaches; a file is read front to back by one task, one record in memory at a time.

Reading groups segments by origin id, orders them by number, verifies the total length and the digests, and decodes the
chunked framing; anything wrong raises ValueError. Blank lines before a record are passed over: where a file's last block
ends in a line break, the text source finds the separator early and leaves one.

A null html is an empty payload, a null url has no target header, a null page_id is archived and comes back null.
Repeated rows of a page are as many records, all responses or all revisits. An empty table gives an empty archive.
Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, slices, stored

SEPARATOR = b"\r\n\r\n"
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
SEGMENT_BYTES = 1 << 15
CHUNK_BYTES = 1 << 12
REVISIT_LEAST = 100
FILE_RECORDS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{digest}|{segment}'.encode()).digest())}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload in chunked transfer coding; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk's size is missing")
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        start, at = line + 2, line + 4 + size
        if body[at - 2 : at] != b"\r\n":
            raise ValueError("a chunk is cut off")
        parts.append(body[start : at - 2])


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(SEPARATOR)
    if not found or not head.startswith(b"HTTP/"):
        raise ValueError("not an HTTP message")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the separator that ends it."""
    lines = [VERSION, *(f"{name}: {value}".encode() for name, value in [*fields, ("Content-Length", len(block))] if value is not None)]
    return b"\r\n".join(lines) + SEPARATOR + block


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, first_page: int | None, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a revisit where first_page is another's, else a response and its continuations."""
    target = url and "".join(f"%{ord(c):02X}" if c < " " else c for c in url)
    own = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Page-Id", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + SEPARATOR
    if first_page is not None:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Refers-To", record_id(first_page, digest)), ("WARC-Profile", PROFILE), *own], head)]
    block = head + chunked(payload)
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    origin = record_id(page_id, digest)
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", origin), ("WARC-Segment-Number", 1 if parts[1:] else None), *own], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        total = len(block) if number == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, digest, number)), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total), ("WARC-Date", DATE)], part))
    return out


def write_archive(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, revisit_least: int = REVISIT_LEAST, file_records: int = FILE_RECORDS) -> None:
    """Writes pages (page_id, url, html) to gzip archives below path."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    copied = rows.where(F.octet_length("payload") >= revisit_least).groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    another = F.when(~F.col("first_page").eqNullSafe(F.col("page_id")), F.col("first_page"))
    # stored, so that Spark can split the rows of a frequent digest
    linked = rows.join(stored(copied, "copied"), "digest", "left").select("page_id", "url", "payload", "digest", another.alias("first_page"))

    def kernel(batch: pa.RecordBatch) -> dict:
        return {"record": [record for row in zip(*(column.to_pylist() for column in batch.columns)) for record in records_of(*row, segment_bytes)]}

    # the cast keeps bytes as they are, also where a segment ends within a character
    map_rows(linked, "record binary", kernel).select(F.col("record").cast("string")).write.option("lineSep", SEPARATOR.decode()).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse_stream(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a stream of bytes; field names in lower case."""
    buffer = bytearray()
    need = 0
    for piece in pieces:
        buffer += piece
        while True:
            while not need and buffer[:1] in (b"\r", b"\n"):
                del buffer[0]
            if len(buffer) < max(need, 1):
                break
            end = buffer.find(SEPARATOR)
            if end < 0:
                break
            lines = bytes(buffer[:end]).split(b"\r\n")
            if not lines[0].startswith(b"WARC/"):
                raise ValueError("no record begins here")
            fields = {name.strip().lower(): value.strip() for name, _, value in (line.decode().partition(":") for line in lines[1:])}
            start, length = end + len(SEPARATOR), int(fields["content-length"])
            need = start + length + len(SEPARATOR)
            if len(buffer) < need:
                break
            if buffer[need - len(SEPARATOR) : need] != SEPARATOR:
                raise ValueError("a record doesn't end where its length says")
            block = bytes(buffer[start : start + length])
            del buffer[:need]
            need = 0
            yield fields, block
    if need or buffer:
        raise ValueError("the last record is cut off")


_RAW = "record_id string, record_type string, page_id long, refers_id string, digest string, origin_id string, segment long, total long, block binary, payload_bytes long, payload binary"
_READ = "record_id string, record_type string, page_id long, refers_id string, payload_bytes long, payload_digest string, payload binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(","))])


_RAW_ARROW, _READ_ARROW = _schema(_RAW), _schema(_READ)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def _checked(payload: bytes, digest: str) -> bytes:
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload's digest is wrong")
    return payload


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record_id, record_type, page_id, refers_id, payload_bytes, payload_digest, payload) of each logical record.

    payload is null for revisits, and for all if payloads is false; then only the blocks of segmented records are
    shuffled.
    """
    lines = spark.read.option("lineSep", SEPARATOR.decode()).text(path).select(F.col("value").cast("binary"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for fields, block in parse_stream(line + SEPARATOR for batch in slices(batches) for line in batch.column(0).to_pylist()):
            own, segment, page = fields["warc-record-id"], fields.get("warc-segment-number"), fields.get("warc-page-id")
            kind, total = fields["warc-type"], fields.get("warc-segment-total-length")
            digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
            payload = _checked(http_payload(block), digest) if kind == "response" and not segment else None
            size = None if payload is None else len(payload)
            out.append((own, kind, page and int(page), fields.get("warc-refers-to"), digest, fields.get("warc-segment-origin-id", own), int(segment or 0), total and int(total), block if segment else None, size, payload if payloads else None))
            if len(out) == 64:
                yield _batch(out, _RAW_ARROW)
                out = []
        if out:
            yield _batch(out, _RAW_ARROW)

    records = lines.mapInArrow(parse, _RAW).repartition("origin_id").sortWithinPartitions("origin_id", "segment")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        group: list[dict] = []
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                if group and row["origin_id"] != group[0]["origin_id"]:
                    yield from _assembled(group, payloads)
                    group = []
                if not row["segment"]:
                    yield row["record_id"], row["record_type"], row["page_id"], row["refers_id"], row["payload_bytes"], row["digest"], row["payload"]
                elif group and group[-1]["segment"] == row["segment"] and group[-1]["block"] == row["block"]:
                    group[-1]["copies"] += 1  # of a page that was archived again
                else:
                    group.append({**row, "copies": 1})
        if group:
            yield from _assembled(group, payloads)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = join(batches)
        while some := list(itertools.islice(rows, 64)):
            yield _batch(some, _READ_ARROW)

    return records.mapInArrow(gathered, _READ)


def _assembled(segments: list[dict], payloads: bool) -> Iterator[tuple]:
    """The record that segments of one origin make, as often as it was archived."""
    first, copies = segments[0], segments[0]["copies"]
    if [(s["segment"], s["copies"]) for s in segments] != [(n + 1, copies) for n in range(len(segments))] or not segments[-1]["total"]:
        raise ValueError(f"segments of {first['origin_id']} are missing")
    block = b"".join(s["block"] for s in segments)
    if len(block) != segments[-1]["total"]:
        raise ValueError(f"the segments of {first['origin_id']} don't have the total length")
    payload = _checked(http_payload(block), first["digest"])
    made = first["record_id"], first["record_type"], first["page_id"], first["refers_id"], len(payload), first["digest"], payload if payloads else None
    yield from itertools.repeat(made, copies)


def resolved(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits get what their response holds.

    index: records of read_archive(), best stored, as both sides of the join read it.
    """
    responses = index.where("record_type = 'response'")
    known = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("of")).dropDuplicates(["refers_id"])
    known = stored(known, "known")  # so that Spark can split the revisits of a frequent response
    # only revisits are joined: the others have no key and would all meet in one task
    joined = index.where("record_type <> 'response'").join(known, "refers_id", "left")
    wrong = ~F.col("of").eqNullSafe(F.col("payload_digest"))
    digest = F.when(wrong, F.raise_error(F.lit("a revisit's digest isn't that of its response"))).otherwise(F.col("payload_digest")).cast("string")
    revisits = joined.select("page_id", F.col("bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
