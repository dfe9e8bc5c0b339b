"""Phrase collocations: counts of all phrases by sorted suffixes, scores of their cuts, phrases within longer ones dropped.

Every word of a piece begins a suffix of at most max_n words. Suffixes go to groups by language and first word; there they
are sorted in reverse order of their words, and one stack of depth max_n counts all their prefixes: a prefix is popped,
with the suffixes passed since it was pushed, where the next suffix no longer begins with it. Here the stack is in the form
of arrays: the places where each depth is popped, and differences of running counts between them.

Equal suffixes of a window of text add up before the shuffle; what is shuffled is a list of suffixes and counts for each
group and window. The number of groups follows from the bytes of all texts. A word with more than a group's share of all
words is dealt to several groups by the word that follows, and by the rest of the suffix where that is such a word too; the
counts of prefixes cut apart so are summed afterwards. Such words are found among those with that share in any window of
text, so that they are no more than a fixed number at any size. Other phrases with fewer than the least count are left where
they are counted. Counts of a phrase's parts are joined afterwards, as every part of a frequent phrase is frequent.

A null text counts as empty, a null language as `und`; rows need no id, and repeated rows count each. Empty tables give no
rows; columns other than the named ones are ignored. Words of any length are kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_runs, common
from .words import mixed, places

#: Bytes of text that a group of suffixes comes from, about, and the most words that are dealt to several groups.
GROUP_BYTES = 4 << 20
MOST_HOT = 10_000
#: Bytes of text whose equal suffixes add up before the shuffle.
WINDOW_BYTES = 2 << 20
#: Phrases that are written as lines at once.
LINES = 1 << 16
#: Stretches that a language's phrases are ranked in first.
RANK_GROUPS = 64
_BLANK, _BREAK = byte_runs.table(b" \t"), byte_runs.table(b".,;:!?\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

GROUPS = "lang string, group long, suffixes string, counts array<long>"
COUNTS = "lang string, n_words int, phrase string, n long"


class Words:
    """The words of a window of texts: where each is among all words, joined by blanks, its piece and its text."""

    def __init__(self, data: np.ndarray, firsts: np.ndarray):
        data, breaks = _LOWER[data], _BREAK[data]
        starts, ends = byte_runs.runs(~(_BLANK | _BREAK)[data], firsts)
        edges = breaks.astype(np.int64)
        edges[firsts] += 1
        self.piece = np.cumsum(edges)[starts]
        self.text = np.searchsorted(firsts, starts, "right") - 1
        lengths = ends - starts
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.joined = np.full(int((lengths + 1).sum()), ord(" "), np.uint8)
        self.joined[places(self.starts, lengths)[0]] = data[places(starts, lengths)[0]]
        self.prefix = byte_runs.prefix_hashes(self.joined)

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the phrases from words first to words last."""
        return byte_runs.hashes(self.prefix, self.starts[first], self.ends[last])

    def last_of_suffix(self, max_n: int) -> np.ndarray:
        """The last word of each word's suffix."""
        at = np.arange(len(self.piece))
        last = np.concatenate([np.flatnonzero(self.piece[1:] != self.piece[:-1]), [len(at) - 1]]) if len(at) else at
        return np.minimum(at + max_n - 1, last[np.searchsorted(last, at)])

    def distinct(self, keys: np.ndarray, first: np.ndarray, last: np.ndarray, targets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions of one of each run of equal phrases, ordered by targets and keys, and the sizes of the runs; equal phrases
        may give more than one run, different ones never share one."""
        order = np.argsort(keys) if targets is None else np.lexsort((keys, targets))
        starts, lengths = self.starts[first[order]], (self.ends[last] - self.starts[first])[order]
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        if targets is not None:
            new[1:] |= targets[order][1:] != targets[order][:-1]
        again = np.flatnonzero(~new)
        new[again] = ~byte_runs.Stretches(self.joined).same(starts[again], starts[again - 1], lengths[again], lengths[again - 1])
        runs = np.flatnonzero(new)
        return order[runs], np.diff(runs, append=len(order))

    def lines(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases from words first to words last as lines, and where each begins, and the last ends."""
        starts, lengths = self.starts[first], self.ends[last] - self.starts[first] + 1
        ends = np.cumsum(lengths)
        data = np.empty(int(lengths.sum()), np.uint8)
        for at in range(0, len(starts), LINES):  # places take eight times their bytes
            some = slice(at, at + LINES)
            data[ends[at] - lengths[at] : ends[some][-1]] = self.joined[places(starts[some], lengths[some])[0]]
        data[ends - 1] = ord("\n")
        return data, np.concatenate([[0], ends])


def _windows(part: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray]]:
    """The words of the windows of a slice with columns lang and text, and the row of the slice that each is from."""
    data, offsets = byte_runs.text_bytes(part.column("text"))
    for at, end in byte_runs.windows(data, offsets, _BREAK, WINDOW_BYTES):
        row = np.searchsorted(offsets, at, "right") - 1
        inside = np.flatnonzero((offsets[:-1] > at) & (offsets[:-1] < end))
        words = Words(data[at:end], np.concatenate([[0], offsets[inside] - at]))
        yield words, np.concatenate([[row], inside])[words.text]


def _texts(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), common.text_of(text_column).alias("text"))


class Groups:
    """The groups that suffixes go to: how many there are, and over how many a frequent word's suffixes are dealt."""

    def __init__(self, count: int, frequent: dict[str, float]):
        """frequent: words with a share of at least share() of all words, with these shares."""
        self.count, self.words = count, sorted(frequent)
        self.least = max(1, -(-count // MOST_HOT))  # of any word
        own = Words(np.frombuffer(" ".join(self.words).encode(), np.uint8), np.zeros(min(1, len(self.words)), np.int64))
        each = np.arange(len(self.words))
        hashed, spread = own.hashes(each, each), [self.least + int(frequent[word] * count) for word in self.words]
        order = np.argsort(hashed)
        self.hashes, self.spread = hashed[order], np.array(spread, np.uint64)[order]

    @staticmethod
    def share(count: int) -> float:
        return 1 / min(MOST_HOT, max(2, count))

    def of(self, words: Words, last: np.ndarray) -> np.ndarray:
        """The group of each word's suffix."""
        first = np.arange(len(last))
        hashed = words.hashes(first, first)
        hot, spread = np.zeros(len(last), bool), np.full(len(last), self.least, np.uint64)
        if len(self.hashes):
            known = np.searchsorted(self.hashes, hashed).clip(0, len(self.hashes) - 1)
            hot = self.hashes[known] == hashed
            spread[hot] = self.spread[known[hot]]
        salt, longer = np.zeros(len(last), np.uint64), np.flatnonzero((spread > 1) & (last > first))
        salt[longer] = np.where(hot[longer + 1], words.hashes(longer + 1, last[longer]), hashed[longer + 1]) % spread[longer]
        return (mixed(hashed + salt) % np.uint64(self.count)).astype(np.int64)

    def cut(self, words: pa.Array, ids: np.ndarray, depth: int, max_n: int) -> np.ndarray:
        """Of prefixes of that depth, with the numbers of their words among words, those that several groups may hold."""
        hot = np.append(np.asarray(pc.is_in(words, value_set=pa.array(self.words, words.type))), False)
        spread = hot[ids[:, 0]] | (self.least > 1)
        return spread if depth == 1 else spread & hot[ids[:, 1]] if depth < max_n else np.zeros(len(ids), bool)


def frequent_words(docs: DataFrame, share: float) -> DataFrame:
    """(lang, word, n): the words of each language, with null for a word; and, with null for a language, words by what they
    hold where they have that share of a window's words. A word with twice the share of all words has at least the share so."""
    schema = "lang string, word string, n long"
    arrow = common.arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, common.BATCH_ROWS):
            coded = part.column("lang").dictionary_encode()
            langs = np.asarray(coded.indices, np.int64)
            for words, rows in _windows(part):
                at = np.arange(len(rows))
                one, n = words.distinct(words.hashes(at, at), at, at)
                hot = one[n >= share * len(rows)]
                totals = np.bincount(langs[rows], minlength=len(coded.dictionary))
                texts = [words.joined[words.starts[i] : words.ends[i]].tobytes().decode() for i in hot]
                yield pa.RecordBatch.from_arrays([pa.array(coded.dictionary.to_pylist() + [None] * len(hot), pa.string()), pa.array([None] * len(totals) + texts, pa.string()), pa.array(np.concatenate([totals, n[n >= share * len(rows)]]))], schema=arrow)

    return common.small_batches(docs).mapInArrow(run, schema).where("n > 0").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def suffixes(docs: DataFrame, groups: Groups, max_n: int) -> DataFrame:
    """GROUPS of (lang, text): for each window and group the distinct suffixes as lines, with their counts."""
    arrow = common.arrow_schema(docs.sparkSession, GROUPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, common.BATCH_ROWS):
            coded = part.column("lang").dictionary_encode()
            langs = np.asarray(coded.indices, np.int64)
            for words, rows in _windows(part):
                if not len(rows):
                    continue
                first, last = np.arange(len(rows)), words.last_of_suffix(max_n)
                target = langs[rows] * groups.count + groups.of(words, last)
                one, n = words.distinct(words.hashes(first, last), first, last, target)
                data, offsets = words.lines(first[one], last[one])
                begins = np.flatnonzero(np.concatenate([[True], target[one][1:] != target[one][:-1]]))
                of = target[one][begins]
                lines = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets[np.append(begins, len(one))].astype(np.int32)), pa.py_buffer(data))
                counts = pa.ListArray.from_arrays(pa.array(np.append(begins, len(one)).astype(np.int32)), pa.array(n.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()).take(pa.array(of // groups.count)), pa.array(of % groups.count), lines, counts], schema=arrow)
                common.give_back()

    return common.small_batches(docs).mapInArrow(run, GROUPS)


def count_prefixes(lines: pa.Array, counts: np.ndarray, max_n: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(depth, the distinct words, the words of each prefix by their numbers, its count) of lines of suffixes.

    Suffixes in reverse order of their words pass a stack of depth max_n; at each depth prefixes are popped where one of the
    words so far changes, with what the running count has grown by since the pop before.
    """
    data, _ = byte_runs.text_bytes(lines)
    ends = np.flatnonzero((data == ord(" ")) | (data == ord("\n")))
    n_words = np.diff(np.flatnonzero(data[ends] == ord("\n")), prepend=-1)
    coded = pc.ascii_split_whitespace(lines).flatten()
    coded = coded.filter(pc.not_equal(coded, "")).dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = np.full((len(n_words), max_n), -1, np.int64)
    ids[np.arange(max_n) < n_words[:, None]] = rank[np.asarray(coded.indices)]
    width = len(order) + 1
    if width**max_n < 1 << 63:
        keys = reduce(lambda key, column: key * width + column + 1, ids.T, np.zeros(len(ids), np.int64))
        passed = np.argsort(keys)[::-1]
    else:
        passed = np.lexsort(ids.T[::-1])[::-1]
    ids, running = ids[passed], np.concatenate([[0], np.cumsum(counts[passed])])
    changed = np.zeros(len(ids), bool)
    changed[:1] = True
    words = coded.dictionary.take(pa.array(order))
    for depth in range(1, max_n + 1):
        changed[1:] |= ids[1:, depth - 1] != ids[:-1, depth - 1]
        pushed = np.flatnonzero(changed)
        n = np.diff(running[np.append(pushed, len(ids))])
        deep = ids[pushed, depth - 1] >= 0
        yield depth, words, ids[pushed[deep]], n[deep]


def counted(docs: DataFrame, groups: Groups, max_n: int, least: int) -> DataFrame:
    """COUNTS of all phrases of (lang, text) with at least that count."""
    arrow = common.arrow_schema(docs.sparkSession, COUNTS)

    def stack(key: tuple, table: pa.Table) -> pa.Table:
        lines, counts = (table.column(name).combine_chunks() for name in ("suffixes", "counts"))
        out = []
        for depth, words, ids, n in count_prefixes(lines, np.asarray(counts.flatten(), np.int64), max_n):
            keep = (n >= least) | groups.cut(words, ids, depth, max_n)
            texts = [words.take(pa.array(column)) for column in ids[keep, :depth].T]
            phrase = pc.binary_join_element_wise(*texts, " ") if depth > 1 else texts[0]
            out.append(pa.table([pa.repeat(key[0], len(phrase)), pa.repeat(pa.scalar(depth, pa.int32()), len(phrase)), phrase, pa.array(n[keep])], schema=arrow))
        common.give_back()
        return pa.concat_tables(out)

    parts = suffixes(docs, groups, max_n).groupBy("lang", "group").applyInArrow(stack, COUNTS)
    return parts.groupBy("lang", "n_words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def scored(counts: DataFrame, max_n: int, least_covered_percent: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates among COUNTS that no longer one covers: the cut with the least score."""
    words, n_words = F.split("phrase", " "), F.col("n_words")
    joined = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), n_words - 1), lambda k: F.array(F.struct(k.alias("k"), F.lit("l").alias("side"), joined(F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit("r").alias("side"), joined(k + 1, n_words - k).alias("part")))))
    candidates = counts.where("n_words > 1")
    parts = candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    sides = parts.join(counts.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"]).select("lang", "phrase", "a", "k", "side", "n", F.lit(None).cast("long").alias("longer"))
    within = F.flatten(F.transform(F.sequence(F.lit(2), n_words - 1), lambda size: F.transform(F.sequence(F.lit(1), n_words - size + 1), lambda start: joined(start, size))))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("a", "long"), ("k", "int"), ("side", "string"), ("n", "long"))]
    covered = candidates.where("n_words > 2").select("lang", F.explode(within).alias("phrase"), *nothing, F.col("n").alias("longer"))
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("n"))).alias(f"{side}{k}")
    both = sides.unionByName(covered).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *(of(k, side) for k in range(1, max_n) for side in "lr"))
    exact = lambda k: F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l{k} AS DECIMAL(19,0)) * CAST(r{k} AS DECIMAL(19,0)))")
    cut = [F.when(F.col(f"l{k}").isNotNull(), F.struct(exact(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, max_n)]
    kept = both.where(F.col("longer").isNull() | (100 * F.col("longer") < least_covered_percent * F.col("a")))
    return kept.select("lang", "phrase", "a", (F.least(*cut) if len(cut) > 1 else cut[0]).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, most: int = 2000, max_n: int = 3, least: int = 10, least_covered_percent: int = 50, text_column: str = "text", lang_column: str = "lang", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to max_n words.

    Counts are exact at any size; scores are as long as 10^6 times a count's square fits into 38 digits.
    """
    texts = _texts(docs, text_column, lang_column)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-size // group_bytes))
    share = Groups.share(count)
    words = common.stored(frequent_words(texts, share), "words")
    totals = words.where("word IS NULL").select("lang", "n")
    n = totals.agg(F.sum("n")).first()[0] or 1
    hot = words.where(F.col("lang").isNull() & (F.col("n") >= share * n)).collect()  # no more rows than 1 / share
    groups = Groups(count, {row["word"]: row["n"] / n for row in hot})
    counts = common.stored(counted(texts, groups, max_n, least), "counts")
    # of each language's stretches first, so that no task ranks all of its phrases
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    stretch = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
    near = scored(counts, max_n, least_covered_percent).withColumn("stretch", stretch).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "stretch").orderBy(*order))).where(F.col("rank") <= most)
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
