"""Audit of how quality filters interact: what each removes at its step of every order, alone, and on average.

Texts are scanned where they lie in Arrow buffers: classes of bytes and prefix sums count words, capitals, code points and
symbols; the hashes of a document's words, sorted, and verified byte by byte where they are equal, count its distinct words.
From then on a document is one bit for each filter that it fails. Copies are found by SHA-256 of the text. Counts by part
and mask are all that orders and steps need: at most 32 rows a part, which a product with a fixed matrix turns into the rows
of all orders.

Documents with equal ids, parts and texts add up before any shuffle, those of one text before the smallest id is looked up, so
a hot part, text or missing id is no larger task than others.

A null text counts as empty, a null part as the empty string. A row without an id fails as a copy never and makes none;
it has no labels. Of rows with the same text all with the smallest id count as originals. An id labelled more than once is
good, or toxic, if any of its rows says so. Empty tables give no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import byte_runs, common

#: Filters in the order of their bits; the last is that of copies.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT = 200, 50, 2

_SPACE = byte_runs.table(b" \t\n\x0b\x0c\r")
_CAPITAL = byte_runs.table(bytes(range(ord("A"), ord("Z") + 1)))
_SYMBOL = byte_runs.table(b"#$%&*|")
_CHARACTER = np.arange(256) & 0xC0 != 0x80  # bytes that begin a character
#: Bits of a key that number a slice's rows.
_ROW_BITS = 8

MEASURES = "words long, distinct long, capitals long, chars long, symbols long, digest binary"


def measure(column: pa.Array) -> dict[str, np.ndarray | list[bytes]]:
    """MEASURES of each text of a column of at most 256 texts."""
    data, offsets = byte_runs.text_bytes(column)
    counts = {name: np.zeros(len(column), np.int64) for name in ("words", "distinct", "capitals", "chars", "symbols")}
    starts, ends, keys = [], [], []
    for at, end in byte_runs.windows(data, offsets, _SPACE):
        part = data[at:end]
        bounds = np.clip(offsets, at, end) - at
        begin, stop = byte_runs.runs(~_SPACE[part], offsets[(offsets >= at) & (offsets < end)] - at)
        word_starts = np.zeros(len(part), bool)
        word_starts[begin] = True
        for name, found in (("words", word_starts), ("capitals", _CAPITAL[part]), ("chars", _CHARACTER[part]), ("symbols", _SYMBOL[part])):
            sums = np.concatenate([[0], np.cumsum(found)])
            counts[name] += np.diff(sums[bounds])
        rows = np.searchsorted(offsets, at + begin, "right") - 1
        keys.append(byte_runs.hashes(byte_runs.prefix_hashes(part), begin, stop) >> np.uint64(_ROW_BITS) | rows.astype(np.uint64) << np.uint64(64 - _ROW_BITS))
        starts.append(at + begin)
        ends.append(at + stop)
    if keys:
        counts["distinct"] += distinct_words(data, *map(np.concatenate, (keys, starts, ends)), len(column))
    return counts | {"digest": [hashlib.sha256(data[a:b]).digest() for a, b in itertools.pairwise(offsets.tolist())]}


def distinct_words(data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: int) -> np.ndarray:
    """Distinct words of each row by their sorted keys; where words with equal keys differ, by the words themselves."""
    order = np.argsort(keys)
    keys, starts, lengths = keys[order], starts[order], (ends - starts)[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    again = np.flatnonzero(~new)
    row_of = lambda of: (of >> np.uint64(64 - _ROW_BITS)).astype(np.int64)
    counts = np.bincount(row_of(keys[new]), minlength=rows)
    verified = byte_runs.Stretches(data).same(starts[again], starts[again - 1], lengths[again], lengths[again - 1])
    for row in np.unique(row_of(keys[again[~verified]])):
        own = row_of(keys) == row
        counts[row] = len({data[s : s + n].tobytes() for s, n in zip(starts[own], lengths[own])})
    return counts


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(id, part) and MEASURES of every document."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), common.text_of(part_column).alias("part"), common.text_of(text_column).alias("text"))
    return common.map_rows(rows, f"id long, part string, {MEASURES}", lambda b: {"id": b.column("id"), "part": b.column("part")} | measure(b.column("text")), 1 << _ROW_BITS)


def failed() -> Column:
    """Bits of the filters that a measured text fails by itself."""
    words = F.col("words")
    tests = (words < LEAST_WORDS, F.col("distinct") * 100 < words * LEAST_DISTINCT_PERCENT, F.col("capitals") * 100 > F.col("chars") * MOST_CAPITAL_PERCENT, F.col("symbols") > 0)
    return sum((F.when(test, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, test in enumerate(tests)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail; labels has doc_id, quality and toxic."""
    rows = measured(docs).select("id", "part", "digest", failed().alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    is_one = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("key")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).withColumn("known", F.lit(True))
    # rows without an id have no labels: they are dealt out by their text
    keyed = rows.withColumn("known", F.col("id").isNotNull()).withColumn("key", F.coalesce("id", F.xxhash64("digest", "part")))
    labelled = keyed.join(marks, ["key", "known"], "left").withColumns({name: F.coalesce(name, F.lit(False)) for name in ("good", "toxic")})
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    texts = labelled.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    smallest = F.min("first.id").over(Window.partitionBy("digest"))  # a row for each part and label of a text
    originals = F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(0) + F.col("unnamed")
    split = texts.withColumn("smallest", smallest).withColumn("originals", originals)
    copy = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("originals")).alias("n"))))
    counted = split.select("part", "good", "toxic", both.alias("own")).select("part", "own.mask", "own.n", "good", "toxic").where("n > 0")
    of = lambda name: F.sum(F.when(F.col(name), F.col("n")).otherwise(0)).alias(name)
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


@lru_cache(maxsize=1)
def steps() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The orders and, for each order, step and mask, whether it is kept, removed or redundant there, and whether it fails that
    filter alone."""
    orders, every = ["".join(p) for p in itertools.permutations(FILTERS)], np.arange(1 << len(FILTERS))
    bits = np.array([[1 << FILTERS.index(name) for name in order] for order in orders]).reshape(-1, len(FILTERS))
    before = (np.cumsum(bits, axis=1) - bits)[:, :, None]
    own, earlier = every & bits[:, :, None] > 0, every & before > 0
    return orders, ~own & ~earlier, own & ~earlier, own & earlier, every == bits[:, :, None]


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counted: DataFrame) -> DataFrame:
    """RESULT from masks(): a row for each part, order and step."""
    schema = common.arrow_schema(counted.sparkSession, RESULT)
    parts = counted.groupBy("part").agg(*(F.collect_list(name).alias(name) for name in ("mask", "n", "good", "toxic")))  # 32 a part at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, *tables = steps()
        kept, removed, redundant, alone = (t.reshape(-1, t.shape[2]).T.astype(np.int64) for t in tables)
        first_bits = np.array([FILTERS.index(name) for order in orders for name in order])
        for part in common.slices(batches, 64):
            rows = np.repeat(np.arange(part.num_rows), np.asarray(part.column("mask").value_lengths()))
            counts = {name: np.zeros((part.num_rows, 1 << len(FILTERS)), np.int64) for name in ("n", "good", "toxic")}
            for name, of in counts.items():
                of[rows, np.asarray(part.column("mask").flatten())] = np.asarray(part.column(name).flatten())
            gone = counts["n"] @ removed
            shares = np.stack([gone[:, first_bits == bit].sum(axis=1) for bit in range(len(FILTERS))], axis=1)[:, first_bits]
            columns = [counts["n"] @ kept, gone, counts["n"] @ redundant, counts["n"] @ alone, counts["good"] @ removed, counts["toxic"] @ removed, shares]
            names = [part.column("part").take(pa.array(np.repeat(np.arange(part.num_rows), gone.shape[1]))), pa.array(np.repeat(orders, len(FILTERS)).tolist() * part.num_rows)]
            at_step = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), part.num_rows * len(orders)))
            yield pa.RecordBatch.from_arrays([*names, at_step, *(pa.array(c.ravel()) for c in columns)], schema=schema)

    return parts.mapInArrow(run, RESULT)
