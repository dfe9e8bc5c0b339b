"""Digests of formatted conversations, read back from the formatted segments alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .chat import INSTRUCT, Codec, Template
from .common import slices

DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_invalid long"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_invalid", pa.int64())])


class _Reader:
    """The digests of one conversation, fed turn by turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss_chars, self.invalid = conv_id, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, codec: Codec, texts: list[str], learnt: list[bool], valid: bool) -> None:
        formatted = "".join(texts)
        self.chars += len(formatted)
        self.invalid += not valid
        for role, text, _, _ in codec.parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for part, flag in zip(texts, learnt):
            if flag:
                plain = codec.unescape(part)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.invalid


def digests(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row for each conversation of format_conversations(), in the partitions and order in which it left them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, reader = Codec(template), None
        for batch in slices(batches):
            done = []
            for conv_id, first, valid, texts, learnt in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "first", "valid", "texts", "learnt"))):
                if first:
                    done += [reader.row()] if reader else []
                    reader = _Reader(conv_id)
                reader.feed(codec, texts, learnt, valid)
            if done:
                yield _batch(done)
        if reader:
            yield _batch([reader.row()])

    return formatted.mapInArrow(run, DIGESTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _ARROW)], schema=_ARROW)
