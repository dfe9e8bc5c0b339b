"""Texts of a slice split and hashed at once in numpy: maximal runs of characters of one class, by a table of classes.

A run's hash is the mixed sum of its code points times a weight of their place. Nothing is kept between calls but the
tables; long texts go through windows of bounded size that are cut between runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters that are split at once.
WINDOW_CHARS = 1 << 20
_MULTIPLY = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(_MULTIPLY[1])
    x ^= x >> np.uint64(27)
    x *= np.uint64(_MULTIPLY[2])
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def classes(*patterns: str) -> np.ndarray:
    """For each code point the number, from 1, of the first pattern of one character that it matches, else 0."""
    everything = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(everything), np.uint8)
    for number, pattern in reversed(list(enumerate(patterns, 1))):
        for found in re.finditer(f"(?:{pattern})+", everything):
            out[found.start() : found.end()] = number
    return out


#: No character from here on has a case.
CASED_END = 0x1E944


@lru_cache(maxsize=1)
def lower_case() -> np.ndarray:
    """For each code point its lower case, or itself where that is more than one."""
    out = np.arange(0x110000, dtype=np.uint32)
    for at in range(CASED_END):
        low = chr(at).lower()
        if len(low) == 1:
            out[at] = ord(low)
    return out


@lru_cache(maxsize=1)
def cases() -> np.ndarray:
    """For each code point 1 if it is upper case, 2 if lower or title case, else 0."""
    out = np.zeros(0x110000, np.uint8)
    out[:CASED_END] = [1 if (c := chr(at)).isupper() else 2 if c.islower() or c.istitle() else 0 for at in range(CASED_END)]
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def windows(joined: str, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first character, code points, their classes) of the windows of a text, none of which cuts a run of one class."""
    at = 0
    while at < len(joined):
        size = WINDOW_CHARS
        while True:
            chars = np.frombuffer(joined[at : at + size].encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds, last = table[chars], at + size >= len(joined)
            if last:
                end = len(chars)
                break
            other = np.flatnonzero(kinds != kinds[-1])
            if not kinds[-1] or len(other):
                end = len(chars) if not kinds[-1] else int(other[-1]) + 1
                break
            size *= 2  # for a run longer than that
        yield at, chars[:end], kinds[:end]
        at += end


def runs(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of one class, class 0 left out."""
    change = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    starts = np.concatenate([[0], change]) if len(kinds) else np.zeros(0, np.int64)
    lengths = np.diff(starts, append=len(kinds))
    inside = kinds[starts] > 0
    return starts[inside], lengths[inside]


def places(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where all characters of the runs are, one run after the other, and where each run begins among these."""
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths), first


def run_hashes(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at, first = places(starts, lengths)
    weights = mixed((np.arange(1, int(lengths.max()) + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(_MULTIPLY[0]))
    values = (chars[at] + np.uint64(1)) * weights[at - np.repeat(starts, lengths)]
    return mixed(np.add.reduceat(values, first))


def joined_texts(texts: list[str]) -> tuple[str, np.ndarray]:
    """The texts with a line end between them, and where each begins, and the last ends."""
    return "\n".join(texts), np.concatenate([[0], np.cumsum([len(text) + 1 for text in texts], dtype=np.int64)])
