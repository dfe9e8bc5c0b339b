"""Byte-level BPE by the tiktoken library: encoding with a local rank file, raw-byte decoding.

Nulls and empty texts encode to no ids, which decode to no bytes. Long texts are cut at safe boundaries first, where no
match of the split pattern can cross, so the ids are those of the whole text and memory stays bounded. Rows are
independent: repeated rows give equal results, an empty table an empty result, and columns other than the named ones
are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_of

#: The split pattern runs only within white space, letters or digits, so a match always ends where white space follows
#: another character, or where letters or digits end. Only characters that every Unicode version classifies alike count.
SAFE_CUT = re.compile(
    r"(?<=\S)(?=[ \t\r\n])"
    r"|(?<=[A-Za-z])(?=[\x00-\x40\x5b-\x60\x7b-\x7f])"
    r"|(?<=[0-9])(?=[\x00-\x2f\x3a-\x7f])"
    r"|(?<=[ぁ-ゖァ-ヺ一-龥])(?=[、。！，？])"
)


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """One encoder for each worker process."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, chars: int) -> Iterator[str]:
    """Parts of text, cut at the first safe boundary at or after each multiple of chars."""
    start = 0
    while len(text) - start > chars:
        cut = SAFE_CUT.search(text, start + chars)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoder: tiktoken.Encoding, text: str, part_chars: int = 1 << 16) -> np.ndarray:
    return np.concatenate([np.array(encoder.encode_ordinary(part), dtype="<u4") for part in safe_parts(text, part_chars)])


def encode(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", part_chars: int = 1 << 16) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, the compact form in which tokens are stored."""

    def kernel(batch: pa.RecordBatch) -> dict:
        encoder = encoding(ranks_path, pattern)
        return {"doc_id": batch.column(0), "ids": [encode_text(encoder, text, part_chars).tobytes() for text in batch.column(1).to_pylist()]}

    return map_rows(df.select(F.col(id_column).cast("long"), text_of(text_column)), "doc_id long, ids binary", kernel)


def decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes): the raw bytes of the ids, which need not be valid UTF-8."""

    def kernel(batch: pa.RecordBatch) -> dict:
        encoder = encoding(ranks_path, pattern)
        return {"doc_id": batch.column(0), "ids": batch.column(1), "bytes": [encoder.decode_bytes(np.frombuffer(ids or b"", "<u4").tolist()) for ids in batch.column(1).to_pylist()]}

    return map_rows(df.select("doc_id", "ids"), "doc_id long, ids binary, bytes binary", kernel)
