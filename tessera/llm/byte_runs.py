"""Texts of a slice scanned where they lie in an Arrow buffer: classes of bytes, runs of one class, hashes by prefix sums.

In UTF-8 all bytes of characters beyond ASCII are 128 and more, so that runs between ASCII characters are runs of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import mixed

#: Bytes that are scanned at once, if there is a place to cut.
WINDOW_BYTES = 1 << 20
#: Bytes of words that are compared in eights before the rest is compared as a whole.
COMPARED_BYTES = 64


def table(characters: bytes) -> np.ndarray:
    """For each byte whether it is one of these characters."""
    out = np.zeros(256, bool)
    out[[*characters]] = True
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and where each begins, and the last ends."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def windows(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, size: int = WINDOW_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of windows of about size bytes that end where a text ends or behind a byte of breaks."""
    at = 0
    while at < len(data):
        end = len(data)
        if at + size < end:
            end = int(offsets[np.searchsorted(offsets, at + size, "right") - 1])
            if end <= at:  # within a text
                last, reach = int(offsets[np.searchsorted(offsets, at, "right")]), size
                while end <= at:
                    cuts = np.flatnonzero(breaks[data[at : min(last, at + reach)]])
                    end = at + int(cuts[-1]) + 1 if len(cuts) else last if at + reach >= last else at
                    reach *= 2
        yield at, end
        at = end


def runs(inside: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes inside, none of which goes on across a text's first byte."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[0] = edge[-1] = True
    edge[firsts] = True
    starts = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
    ends = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


#: Powers are kept in multiples of this number.
POWERS = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_NUMBERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _powers_of(name: str, step: int, size: int) -> np.ndarray:
    """At least size powers of an odd number modulo 2^64."""
    if len(_powers.get(name, ())) < max(1, size):
        steps = np.full(-(-max(1, size) // POWERS) * POWERS, step, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums, before each byte and behind the last, of a number for each byte times a power for its place."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_NUMBERS[data] * _powers_of("place", _BASE, len(data))[: len(data)], out=out[1:])
    return out


def hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, wherever it stands: equal hashes are to be verified by same()."""
    inverse = _powers_of("inverse", pow(_BASE, -1, 1 << 64), len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts])


class Stretches:
    """Compares stretches of a buffer, eight bytes of many at once."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.data, self.eights = padded, np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))

    def same(self, a: np.ndarray, b: np.ndarray, lengths: np.ndarray, other_lengths: np.ndarray) -> np.ndarray:
        """Whether the stretches from a and from b hold the same bytes."""
        out = lengths == other_lengths
        for done in range(0, COMPARED_BYTES, 8):
            at = np.flatnonzero(out & (lengths > done))
            if not len(at):
                return out
            unused = np.uint64(64) - np.uint64(8) * np.minimum(lengths[at] - done, 8).astype(np.uint64)
            out[at] = (self.eights[a[at] + done] ^ self.eights[b[at] + done]) << unused == 0
        for i in np.flatnonzero(out & (lengths > COMPARED_BYTES)):
            out[i] = self.data[a[i] : a[i] + lengths[i]].tobytes() == self.data[b[i] : b[i] + lengths[i]].tobytes()
        return out
