"""Media columns in Ogg: byte payloads stored as laced, checksummed pages of two logical streams, read back and verified.

A medium holds a data stream, whose packets are the payload as 8-bit samples, and a notes stream with one packet that
tells the unpadded length. Pages of both are interleaved; the reader verifies every page's checksum and sequence,
reassembles packets from lacing values across pages, demultiplexes by serial number and turns granule positions into
timestamps. A medium depends on its text alone, so equal texts give equal values.

Nulls count as empty texts, which become one frame of padding. Rows are independent: an empty table gives an empty
result, and columns other than the named ones are ignored. A damaged page raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_of

FRAME = 576
PAD = b"\xff"
#: Samples a second, and so granule units a second.
RATE = 8000
DATA_SERIAL, NOTES_SERIAL = 1, 2
#: Flags of a page: it continues a packet, it is the first or the last of its stream.
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
CHECKSUM_AT, LACES_AT = 22, 27
MOST_LACES = 255
NO_PACKET_ENDS = -1

_REVERSED = bytes(int(f"{byte:08b}"[::-1], 2) for byte in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0, not inverted.

    zlib has the same polynomial with the bits of bytes and result reversed; its inversions are undone here.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def padded(data: bytes, frame: int = FRAME) -> bytes:
    """data with bytes 255 appended up to a positive multiple of frame."""
    return data + PAD * (max(frame, -(-len(data) // frame) * frame) - len(data))


def pages_of(packets: list[bytes], serial: int, granules: list[int]) -> list[bytes]:
    """The pages of one logical stream; granules[k] is the position at the end of packet k."""
    laces: list[tuple[int, int]] = []  # a lacing value, and the packet it ends or -1
    for k, packet in enumerate(packets):
        whole, rest = divmod(len(packet), 255)
        laces += [(255, -1)] * whole + [(rest, k)]
    body, at, pages, sequence = b"".join(packets), 0, [], 0
    for start in range(0, len(laces), MOST_LACES):
        own = laces[start : start + MOST_LACES]
        ended = max(k for _, k in own)
        flags = CONTINUED * (start > 0 and laces[start - 1][1] < 0) | FIRST * (start == 0) | LAST * (start + MOST_LACES >= len(laces))
        size = sum(lace for lace, _ in own)
        head = HEADER.pack(b"OggS", 0, flags, granules[ended] if ended >= 0 else NO_PACKET_ENDS, serial, sequence, 0, len(own))
        page = head + bytes(lace for lace, _ in own) + body[at : at + size]
        pages.append(page[:CHECKSUM_AT] + struct.pack("<I", page_checksum(page)) + page[CHECKSUM_AT + 4 :])
        at, sequence = at + size, sequence + 1
    return pages


def write_medium(data: bytes, frame: int = FRAME) -> bytes:
    payload = padded(data, frame)
    packets = [payload[at : at + frame] for at in range(0, len(payload), frame)]
    samples = pages_of(packets, DATA_SERIAL, [frame * (k + 1) for k in range(len(packets))])
    notes = pages_of([struct.pack("<Q", len(data))], NOTES_SERIAL, [0])
    return b"".join([samples[0], *notes, *samples[1:]])


def read_pages(medium: bytes):
    """(serial, sequence, flags, granule, laces, body) of each page; checksums are verified."""
    at = 0
    while at < len(medium):
        if len(medium) < at + LACES_AT:
            raise ValueError("a page header is cut off")
        capture, version, flags, granule, serial, sequence, checksum, count = HEADER.unpack_from(medium, at)
        if capture != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        laces = medium[at + LACES_AT : at + LACES_AT + count]
        start = at + LACES_AT + count
        end = start + sum(laces)
        if len(laces) < count or len(medium) < end:
            raise ValueError("a page is cut off")
        if page_checksum(b"".join([medium[at : at + CHECKSUM_AT], b"\0\0\0\0", medium[at + CHECKSUM_AT + 4 : end]])) != checksum:
            raise ValueError(f"a page's checksum is wrong at byte {at}")
        yield serial, sequence, flags, granule, laces, medium[start:end]
        at = end


def read_streams(medium: bytes) -> dict[int, list[tuple[bytes, float | None]]]:
    """Packets by serial number, each with the seconds at its end where its page's granule position tells them."""
    streams: dict[int, list[tuple[bytes, float | None]]] = defaultdict(list)
    begun: dict[int, list[bytes]] = defaultdict(list)
    following: dict[int, int] = defaultdict(int)
    ended: set[int] = set()
    for serial, sequence, flags, granule, laces, body in read_pages(medium):
        if sequence != following[serial] or serial in ended or bool(flags & CONTINUED) != bool(begun[serial]) or bool(flags & FIRST) != (sequence == 0):
            raise ValueError(f"stream {serial}: page {sequence} is out of order")
        following[serial] += 1
        at, complete = 0, []
        for lace in laces:
            begun[serial].append(body[at : at + lace])
            at += lace
            if lace < 255:
                complete.append(b"".join(begun[serial]))
                begun[serial] = []
        streams[serial] += [(packet, granule / RATE if k == len(complete) - 1 else None) for k, packet in enumerate(complete)]
        if flags & LAST:
            ended.add(serial)
    if ended != set(following) or any(begun.values()):
        raise ValueError("a stream is cut off")
    return dict(streams)


def features(payload: bytes, seconds: float, packets: int) -> str:
    """Length in time, level, energy and zero crossings of 8-bit samples around 128; whole numbers, so exact everywhere."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((samples[1:] >= 0) != (samples[:-1] >= 0)))
    return f"ms={round(seconds * 1000)};packets={packets};sum={int(samples.sum())};energy={int((samples * samples).sum())};peak={int(np.abs(samples).max())};crossings={crossings}"


def to_media(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", frame: int = FRAME) -> DataFrame:
    """(doc_id, media): each whole text as an Ogg medium."""

    def kernel(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "media": [write_medium(text.encode(), frame) for text in batch.column(1).to_pylist()]}

    return map_rows(df.select(F.col(id_column).cast("long"), text_of(text_column)), "doc_id long, media binary", kernel)


def from_media(df: DataFrame) -> DataFrame:
    """(doc_id, media, payload, n_bytes, seconds, feature): what the stored bytes hold; all null for a null medium."""

    def kernel(batch: pa.RecordBatch) -> dict:
        rows = []
        for medium in batch.column(1).to_pylist():
            if medium is None:
                rows.append((None,) * 4)
                continue
            streams = read_streams(medium)
            packets = streams[DATA_SERIAL]
            payload = b"".join(packet for packet, _ in packets)
            rows.append((payload, struct.unpack("<Q", streams[NOTES_SERIAL][0][0])[0], packets[-1][1], features(payload, packets[-1][1], len(packets))))
        payloads, lengths, seconds, told = zip(*rows)
        return {"doc_id": batch.column(0), "media": batch.column(1), "payload": payloads, "n_bytes": lengths, "seconds": seconds, "feature": told}

    return map_rows(df.select("doc_id", "media"), "doc_id long, media binary, payload binary, n_bytes long, seconds double, feature string", kernel)
