"""A quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector for all grades and ordered thresholds; the expected
grade and the probability of reaching a grade select documents. It is fitted on at most SAMPLE_ROWS labelled rows (the
smallest hashes of their ids), which bounds what comes to the driver at any corpus size; scoring covers whole texts.

Null and empty texts have the features of an empty text. Rows are scored one by one: repeated rows get equal results, an
empty table gives an empty result. Of several ratings of a document the lowest counts, ratings without documents or
grades are left out. Where all of the sample have one grade, every document gets that grade; without any rating, the
highest. Columns other than the named ones are ignored by score(); select_good() keeps them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import SLICE_ROWS, map_rows, small_batches, text_of

SAMPLE_ROWS = 8000
BITS = 20
#: Characters that inflected and compound words share with their stem.
STEM = 4
STEPS, RATE, RIDGE = 400, 0.05, 1e-4
#: Standard errors by which the mean grade of a feature's documents must differ from the mean grade, to be fitted.
SCREEN = 3.0
LEAST_PROBABILITY = 0.5


def _share(part: int, whole: int) -> int:
    """A share as one of about nine levels."""
    return min(8, (part * 16 // whole + 1).bit_length() + 3 * (part * 2 > whole)) if part else 0


def _form(name: str, level: int) -> int:
    return zlib.crc32(f"\0{name}={level}".encode()) >> (32 - BITS)


def features_of(texts: list[str]) -> list[np.ndarray]:
    """For each text the distinct hash buckets of its words and symbols, in lower case, of the stems of longer words, and of
    its form, sorted.

    Words are runs of word characters, symbols runs of others but white space; a run that begins with an underscore
    counts as neither in the shares. Form: shares of words in capitals, of symbols, of distinct buckets, of repeated
    lines and of numbers, and the length, each by levels.
    """
    joined, bounds = words.joined_texts(texts)
    parts = [(np.zeros(0, np.int64), *(np.zeros(0, bool) for _ in range(3)), *(np.zeros(0, np.int64) for _ in range(2)))]
    for at, chars, kinds in words.windows(joined, words.classes(r"\w", r"[^\w\s]")):
        starts, lengths = words.runs(kinds)
        if not len(starts):
            continue
        within, first = words.places(starts, lengths)
        word = (kinds[starts] == 1) & (chars[starts] != ord("_"))
        capitals = word & (lengths > 1) & (np.bitwise_or.reduceat(words.cases()[chars[within]], first) == 1)
        number = word & (words.classes(r"\d")[chars[starts]] > 0)
        low = words.lower_case()[chars]
        bucket = words.run_hashes(low, starts, lengths) >> np.uint64(64 - BITS)
        longer = word & (lengths > STEM)
        stem = np.full(len(starts), -1, np.int64)
        stem[longer] = (words.run_hashes(low, starts[longer], np.full(longer.sum(), STEM), 1) >> np.uint64(64 - BITS)).astype(np.int64)
        parts.append((starts + at, word, capitals, number, bucket.astype(np.int64), stem))
    starts, word, capitals, number, bucket, stem = (np.concatenate(column) for column in zip(*parts))
    text = np.searchsorted(bounds, starts, "right") - 1
    tokens, n_words, n_capitals, n_numbers = (np.bincount(text[which], minlength=len(texts)).tolist() for which in (slice(None), word, capitals, number))
    distinct = words.distinct((text << BITS) | bucket)
    n_distinct = np.bincount(distinct >> BITS, minlength=len(texts)).tolist()
    every = words.distinct(np.concatenate([distinct, ((text << BITS) | stem)[stem >= 0]]))
    cuts = np.searchsorted(every >> BITS, np.arange(len(texts) + 1)).tolist()
    out = []
    for at, own in enumerate(texts):
        lines = own.split("\n")
        form = [
            _form("upper", _share(n_capitals[at], n_words[at])),
            _form("symbols", _share(tokens[at] - n_words[at], tokens[at])),
            _form("distinct", _share(n_distinct[at], tokens[at])),
            _form("lines", _share(len(lines) - len(set(lines)), len(lines))),
            _form("words", n_words[at].bit_length()),
            _form("digits", _share(n_numbers[at], n_words[at])),
        ]
        out.append(words.distinct(np.concatenate([every[cuts[at] : cuts[at + 1]] & ((1 << BITS) - 1), form])).astype(np.int32))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1 on."""
        return _sigmoid(float(self.weights[ids].sum()) - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def screened(features: list[np.ndarray], grades: np.ndarray, least: float = SCREEN) -> list[np.ndarray]:
    """Only the features whose score statistic at zero weights is large; most words of a text tell nothing."""
    flat = np.concatenate(features).astype(np.int64)
    away = np.repeat(grades - grades.mean(), [len(f) for f in features])
    number = np.bincount(flat, minlength=1 << BITS)
    z = np.abs(np.bincount(flat, away, 1 << BITS)) / (np.sqrt(np.maximum(number, 1)) * grades.std())
    return [f[z[f] >= least] for f in features]


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE, screen: float = SCREEN) -> Model:
    """Maximum likelihood with a ridge, by full-batch Adam; thresholds are a first one and positive gaps."""
    if len(set(grades.tolist())) < 2:
        only = grades[0] if len(grades) else n_grades - 1
        return Model(np.zeros(1 << BITS), np.where(np.arange(1, n_grades) <= only, -40.0, 40.0))
    features = screened(features, grades, screen)
    counts = np.array([len(f) for f in features])
    used, flat = np.unique(np.concatenate(features).astype(np.int64), return_inverse=True)
    row_of = np.repeat(np.arange(len(grades)), counts)
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    free = np.concatenate([np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    mean, square = np.zeros_like(free), np.zeros_like(free)
    rows = np.arange(len(grades))
    for step in range(1, steps + 1):
        weights, gaps = free[: len(used)], np.exp(free[len(used) + 1 :])
        thresholds = free[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row_of, weights[flat], len(grades))
        reach = np.column_stack([np.ones(len(rows)), _sigmoid(score[:, None] - thresholds), np.zeros(len(rows))])
        slope = reach * (1 - reach)
        own = np.maximum(reach[rows, grades] - reach[rows, grades + 1], 1e-9)
        by_threshold = np.zeros((len(rows), n_grades + 1))  # of the loss by score - threshold_k
        by_threshold[rows, grades] -= slope[rows, grades] / own
        by_threshold[rows, grades + 1] += slope[rows, grades + 1] / own
        by_score = by_threshold.sum(axis=1) / len(rows)
        by_cut = -by_threshold[:, 1:-1].sum(axis=0) / len(rows)
        gradient = np.concatenate([np.bincount(flat, by_score[row_of], len(used)) + ridge * weights, [by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * gaps])
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        free = free - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = free[: len(used)]
    return Model(weights, free[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(free[len(used) + 1 :]))]))


def rated_features(documents: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of the sample, for ratings (doc_id, grade)."""
    rated = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # so many rows at most are broadcast
    texts = documents.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", F.col("grade").cast("int"), "text")

    def kernel(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "grade": batch.column(1), "ids": [ids.tobytes() for ids in features_of(batch.column(2).to_pylist())]}

    rows = sorted(map_rows(texts, "doc_id long, grade int, ids binary", kernel).dropDuplicates().collect())
    return [np.frombuffer(row["ids"], np.int32) for row in rows], np.array([row["grade"] for row in rows], np.int64)


def train(documents: DataFrame, ratings: DataFrame, n_grades: int, sample_rows: int = SAMPLE_ROWS) -> Model:
    return fit(*rated_features(documents, ratings, sample_rows), n_grades)


def _scorer(df: DataFrame, model: Model):
    """From texts to the probabilities of reaching each grade but the lowest, a row for each."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def reach(texts: list[str]) -> np.ndarray:
        weights, thresholds = shared.value
        sums = np.array([weights[ids].astype(np.float64).sum() for ids in features_of(texts)])
        return _sigmoid(sums[:, None] - thresholds)

    return reach


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, expected_grade, tail_probability): the latter of the highest grade."""
    reach = _scorer(documents, model)

    def kernel(batch: pa.RecordBatch) -> dict:
        found = reach(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "expected_grade": found.sum(axis=1), "tail_probability": found[:, -1].copy()}

    return map_rows(documents.select(F.col("doc_id").cast("long"), text_of("text")), "doc_id long, expected_grade double, tail_probability double", kernel)


def select_good(documents: DataFrame, model: Model, least: float = LEAST_PROBABILITY) -> DataFrame:
    """The documents, with all their columns, whose probability of the highest grade is at least `least`."""
    reach = _scorer(documents, model)

    @F.pandas_udf("double")
    def tail(texts: pd.Series) -> pd.Series:
        every = texts.fillna("").tolist()
        return pd.Series(np.concatenate([np.zeros(0), *(reach(every[at : at + SLICE_ROWS])[:, -1] for at in range(0, len(every), SLICE_ROWS))]))

    return small_batches(documents).where(tail(F.col("text")) >= least)


def grade(quality: Column, toxic: Column) -> Column:
    """The rating that two labels make: a point for quality, a point for not being toxic; null without a quality label."""
    return quality.cast("int") + F.when(toxic == 1, 0).otherwise(1)
