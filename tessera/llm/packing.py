"""Best-fit packing by exact-complement hashing: documents become token pieces, pieces become full sequences.

plan() works on the histogram of piece lengths alone, which has at most `capacity` entries at any corpus size. Sums of
one, two and three available lengths are indexed: how many combinations make each sum, kept up to date as lengths are
used up. The largest length left is completed by a combination that fills its gap exactly, as often as the counts allow,
and where the index has none by the best-fitting single length. Ranks of pieces within their length, counted in balanced
cells, then turn the plan into places without gathering pieces anywhere: a piece's slot is found by binary search.

Null and empty texts are documents with the end id alone. Every row is a document, repeated rows too; rows with no
doc_id are documents without id. Equal rows are ranked as one row with a count. An empty table gives an empty result,
columns other than the named ones are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import map_rows, stored, text_of, worker_cache

END_ID = 1
CAPACITY = 4096
#: Distinct units of words whose ids a worker keeps, about: 40 bytes each.
CACHE_WORDS = 1_000_000
#: Pieces that one cell of the ranking holds, about.
CELL_PIECES = 50_000


#: Letters whose lower case and composition are plain, punctuation that may follow them, and all else but blanks.
LETTER, MARK, OTHER = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[.,;:!?*$&#%|()\-]", r"[^ \n]"


class Tokens:
    """Ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit integers.

    The tokenizer's normalisation and split must never look across a blank or a line end and must drop both, so that the
    ids of a text are those of its blank-separated words one after the other; a file for which that fails on PROBE, or
    whose special tokens hold or take in blanks, raises ValueError. A word of plain letters and punctuation behind them
    (no apostrophe, which goes with the letters after it) is split between both and taken in lower case; any other word
    is one unit. Units are told by a 64-bit hash of a seed of the worker's own, and the ids of those met before are kept
    in flat arrays. Strings of special tokens in a text become these, as the library does, unless special_as_text is set.
    """

    PROBE = "It's  word, Word. WORD!\nDon't we'll-a (b) 3,141 x_y … İst ﬁ éa! a1b2 can't --(a. a)b -"

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        for token in json.loads(self.tokenizer.to_str())["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or set(token["content"]) & set(" \n") or not re.search(f"(?!{LETTER}|{MARK}){OTHER}", token["content"]):
                raise ValueError("a special token holds or takes in blanks, or may be a part of a plain word")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.seed = int.from_bytes(os.urandom(6))
        self._forget()
        if self.of([self.PROBE])[0] != np.array(self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids, "<u4").tobytes():
            raise ValueError("the tokenizer's ids of a text aren't those of its words")

    def _forget(self) -> None:
        #: Sorted hashes with their ids' places in the pool: many old ones, and a few new ones that are soon merged.
        self.old, self.new = ((np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)) for _ in range(2))
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.old[0]) > CACHE_WORDS:
            self._forget()
        joined, bounds = words.joined_texts(texts)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))]
        for at, chars, _ in words.windows(joined, words.classes(OTHER)):
            kinds = self._kinds(chars)
            starts, lengths = words.runs(kinds)
            low = np.where(kinds == 1, words.lower_case()[chars], chars)
            parts.append((starts + at, lengths, words.run_hashes(low, starts, lengths, self.seed), kinds[starts]))
        starts, lengths, hashes, kinds = (np.concatenate(column) for column in zip(*parts))
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = self._known(distinct)
        if len(unknown := np.flatnonzero(place[:, 0] < 0)):
            at = first[unknown]
            strings = [joined[start : start + length] for start, length in zip(starts[at].tolist(), lengths[at].tolist())]
            place[unknown] = self._learn(distinct[unknown], strings, kinds[at])
        place = place[back]
        ends = np.concatenate([[0], np.cumsum(place[:, 1])])
        gathered = np.arange(ends[-1]) + np.repeat(place[:, 0] - ends[:-1], place[:, 1])
        ids = self.pool[gathered]
        cuts = ends[np.searchsorted(starts, bounds)]
        return [ids[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts.tolist()[1:])]

    def _kinds(self, chars: np.ndarray) -> np.ndarray:
        """1 for letters and 2 for punctuation of plain words, 3 in any other word, 0 for blanks."""
        kinds = words.classes(LETTER, MARK, OTHER)[chars]
        starts, lengths = words.runs((kinds > 0).astype(np.uint8))
        if not len(starts):
            return kinds
        odd = kinds == 3
        odd[1:] |= (kinds[:-1] == 2) & (kinds[1:] == 1)
        other = (kinds[starts] != 1) | (np.add.reduceat(odd, starts, dtype=np.int64) > 0)
        kinds[words.places(starts[other], lengths[other])[0]] = 3
        return kinds

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """(start, number) in the pool of each hash, -1 where it is unknown."""
        out = np.full((len(hashes), 2), -1, np.int64)
        for known, place in (self.old, self.new):
            if len(known):
                at = np.searchsorted(known, hashes).clip(0, len(known) - 1)
                found = known[at] == hashes
                out[found] = place[at[found]]
        return out

    def _learn(self, hashes: np.ndarray, strings: list[str], kinds: np.ndarray) -> np.ndarray:
        """Their places in the pool, where they are put now."""
        plain, other = np.flatnonzero(kinds < 3), np.flatnonzero(kinds == 3)
        coded = [self._single([strings[k].lower() for k in plain[at : at + 1000].tolist()]) for at in range(0, len(plain), 1000)]
        found = self.tokenizer.encode_batch_fast([strings[k] for k in other.tolist()], add_special_tokens=False)
        coded.append((np.array([number for each in found for number in each.ids], np.uint32), np.array([len(each.ids) for each in found], np.int64)))
        ids, numbers = (np.concatenate(column) for column in zip(*coded))
        place = np.empty((len(hashes), 2), np.int64)
        place[np.concatenate([plain, other])] = self._put(ids, numbers)
        self.new = self._merged(self.new, (hashes, place))
        if len(self.new[0]) > 1 << 16:
            self.old, self.new = self._merged(self.old, self.new), (np.zeros(0, np.uint64), np.zeros((0, 2), np.int64))
        return place

    def _single(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their numbers by part, of parts that the tokenizer's split leaves whole, in one text: a token that ends
        a word ends a part."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(parts):
            raise ValueError("a part was split")
        return ids, np.diff(ends, prepend=0)

    def _put(self, ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The places (start, number) of ids that follow each other in the pool."""
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(need, 2 * self.used) - self.used, "<u4")])
        self.pool[self.used : need] = ids
        place = np.column_stack([self.used + np.cumsum(numbers) - numbers, numbers])
        self.used = need
        return place

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.concatenate([a[0], b[0]])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], np.concatenate([a[1], b[1]])[order]


def tokens(path: str, special_as_text: bool = False) -> Tokens:
    """One for each worker process."""
    return worker_cache(f"packing {path} {special_as_text}", lambda: Tokens(path, special_as_text))


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenize(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = True, special_as_text: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids or ids_crc32): documents cut at each multiple of capacity, if longer."""
    end = np.array([end_id], "<u4").tobytes()

    def kernel(batch: pa.RecordBatch) -> dict:
        docs, pieces, starts, lengths, ids = [], [], [], [], []
        for doc_id, coded in zip(batch.column(0).to_pylist(), tokens(tokenizer_path, special_as_text).of(batch.column(1).to_pylist())):
            coded += end
            for piece, at in enumerate(range(0, len(coded), 4 * capacity)):
                part = coded[at : at + 4 * capacity]
                docs.append(doc_id)
                pieces.append(piece)
                starts.append(at // 4)
                lengths.append(len(part) // 4)
                ids.append(part if with_ids else zlib.crc32(part))
        return {"doc_id": docs, "piece": pieces, "start": starts, "length": lengths, "ids": ids}

    schema = PIECES if with_ids else PIECES.replace("ids binary", "ids_crc32 long")
    return map_rows(df.select(F.col(id_column).cast("long"), text_of(text_column)), schema, kernel)


class _Stock:
    """Available lengths with their counts, and the index: by sum, how many multisets of one, two and three of them make it."""

    def __init__(self, counts: np.ndarray):
        self.counts = np.zeros_like(counts)
        self.one, self.two, self.three = (np.zeros(len(counts), np.int64) for _ in range(3))
        for length in np.flatnonzero(counts):
            self.put(int(length), int(counts[length]))

    def put(self, length: int, number: int) -> None:
        if not self.counts[length]:
            self._index(length, 1)
        self.counts[length] += number

    def take(self, length: int, number: int) -> None:
        self.counts[length] -= number
        if not self.counts[length]:
            self._index(length, -1)

    def _index(self, length: int, sign: int) -> None:
        """Adds or removes the multisets that hold a length: those of one fewer, with that length among them, and it."""
        if sign > 0:
            self.one[length] = 1
        shorter = len(self.one) - length
        if sign > 0:
            self.two[length:] += self.one[:shorter]
            self.three[length:] += self.two[:shorter]
        else:
            self.three[length:] -= self.two[:shorter].copy()
            self.two[length:] -= self.one[:shorter].copy()
            self.one[length] = 0

    def largest(self, most: int) -> int:
        """The largest available length up to most, or 0."""
        found = self.one[1 : max(most, 0) + 1][::-1]
        return len(found) - int(found.argmax()) if found.any() else 0

    def pair(self, total: int, most: int) -> list[int]:
        """Two available lengths of that sum, the larger up to most and as large as can be, or none."""
        if total < 2 or not self.two[total]:
            return []
        high = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        good = (self.counts[high] > 0) & (self.counts[total - high] > (high * 2 == total))
        return [first := int(high[good.argmax()]), total - first] if good.any() else []

    def exact(self, gap: int) -> list[int]:
        """One, two or three available lengths that sum to gap, or none."""
        if self.one[gap]:
            return [gap]
        if two := self.pair(gap, gap):
            return two
        if not self.three[gap]:
            return []
        first = np.arange(gap - 2, (gap - 1) // 3, -1)
        for length in first[(self.one[first] > 0) & (self.two[gap - first] > 0)].tolist():
            self.counts[length] -= 1
            rest = self.pair(gap - length, length)
            self.counts[length] += 1
            if rest:
                return [length, *rest]
        return []


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, pieces of each length in one) of every pattern; counts: pieces by length, up to capacity."""
    have = np.zeros(capacity + 1, np.int64)
    for length, number in counts.items():
        have[length] = number
    stock, patterns = _Stock(have), []
    while first := stock.largest(capacity):
        chosen = {first: 1}
        stock.take(first, 1)
        gap = capacity - first
        while gap and (more := stock.exact(gap) or [best for best in [stock.largest(gap)] if best]):
            for length in more:
                chosen[length] = chosen.get(length, 0) + 1
                stock.take(length, 1)
                gap -= length
        for length, number in chosen.items():  # all back, then as often as the counts allow
            stock.put(length, number)
        times = min(int(stock.counts[length]) // number for length, number in chosen.items())
        for length, number in chosen.items():
            stock.take(length, number * times)
        patterns.append((times, chosen))
    return patterns


def slots(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, pieces of it in a sequence, first sequence, offset) for each pattern and length.

    Of the pieces of a length, those of rank first + r stand in sequence (first sequence + r div pieces), at offset +
    (r mod pieces) * length.
    """
    out, used, sequence = [], {}, 0
    for times, chosen in patterns:
        offset = 0
        for length, number in sorted(chosen.items(), reverse=True):
            rank = used.get(length, 0)
            out.append((length, rank, times * number, number, sequence, offset))
            used[length] = rank + times * number
            offset += length * number
        sequence += times
    return out


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """pieces with `rank`, from 0 without gaps within each length.

    Pieces are dealt to cells of a length by a hash, so that a frequent length has many cells; a cell's first rank is the
    count of the cells before it. Equal rows go as one with their number, and are dealt out again in blocks.
    """
    cells = max(1, -(-total // CELL_PIECES)) * 4
    once = pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("copies"))
    dealt = once.withColumn("cell", F.pmod(F.xxhash64(*pieces.columns), F.lit(cells)))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "cell").agg(F.sum("copies").alias("n")).select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "cell").orderBy(*(c for c in pieces.columns if c != "length")).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("first") + F.coalesce(F.sum("copies").over(within), F.lit(0))
    placed = dealt.join(firsts, ["length", "cell"]).withColumn("rank", rank)
    blocks = placed.select(*pieces.columns, "rank", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CELL_PIECES).cast("long"))).alias("block"))
    last = F.least(F.col("copies"), F.col("block") + CELL_PIECES) - 1
    return blocks.select(*pieces.columns, "rank", F.explode(F.sequence("block", last)).alias("copy")).select(*pieces.columns, (F.col("rank") + F.col("copy")).alias("rank"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    The pieces are written once to shared storage. Only their histogram by length, of at most `capacity` rows, comes to
    the driver; the slots sent out hold an entry for each pattern and length: at most capacity * log2(pieces) patterns,
    as each at least halves the count of a length, of sqrt(2 capacity) lengths at most, as these sum to a sequence.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    placed = np.array(sorted(slots(plan(counts, capacity))), np.int64).reshape(-1, 6)
    total = sum(counts.values())
    shared, columns = spark.sparkContext.broadcast((placed, placed[:, 0] * (total + 1) + placed[:, 1])), pieces.columns

    def kernel(batch: pa.RecordBatch) -> dict:
        table, starts = shared.value
        length, rank = (batch.column(at).to_numpy() for at in (3, 5))
        _, first, _, each, sequence, at = table[np.searchsorted(starts, length * (total + 1) + rank, "right") - 1].T
        inside = rank - first
        return dict(zip(columns, batch.columns)) | {"sequence_id": sequence + inside // each, "offset": at + inside % each * length}

    return map_rows(ranked(pieces, total), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", kernel, rows=65536)
