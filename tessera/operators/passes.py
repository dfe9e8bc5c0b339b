"""One pass over vectors for many sums at once, and a minimiser that needs a pass for each step of many models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors that are handed to Python at once, about, with 8 for each component; most rows at once.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 10_000

SUMS = "model int, i int, v double"
_SUMS = pa.schema([("model", pa.int32()), ("i", pa.int32()), ("v", pa.float64())])


def bounded_batches(rows: DataFrame, width: int) -> DataFrame:
    """rows, after its session is set to hand vectors of that width to Python in batches of bounded bytes."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", max(1, min(BATCH_ROWS, BATCH_BYTES // (8 * max(1, width)))))
    return rows


def matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """A column of arrays as a matrix of that width; shorter ones have zeros on the right, as have missing components."""
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    values = np.asarray(column.flatten().fill_null(0), kind)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), kind)
    inside = np.arange(int(lengths.max(initial=0))) < lengths[:, None]
    rows, at = np.nonzero(inside)
    out[rows[at < width], at[at < width]] = values[at < width]
    return out


def summed(rows: DataFrame, width: int, sums: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all batches of sums(batch), a matrix of shape (models, numbers a model).

    Tasks add up their own batches and hand on a row for each number, which Spark adds up: what crosses to the driver is
    the sum, of a model's size, at any number of rows and tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += sums(batch)
        for model, own in enumerate(total):
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), model, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], schema=_SUMS)

    found = bounded_batches(rows, width).mapInArrow(run, SUMS).groupBy("model", "i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(shape)
    out[np.asarray(found["model"]), np.asarray(found["i"])] = np.asarray(found["v"])
    return out


class _Descent:
    """One model's way down: limited-memory quasi-Newton directions with halved steps."""

    MEMORY, ENOUGH, LEAST_STEP = 12, 1e-4, 1e-12

    def __init__(self, start: np.ndarray, tolerance: float):
        self.at, self.trial, self.tolerance, self.done = start, start, tolerance, False
        self.value, self.gradient, self.direction, self.step = np.inf, None, None, 1.0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def told(self, value: float, gradient: np.ndarray) -> None:
        """Takes the value and gradient at the trial point and chooses the next."""
        if self.gradient is not None:
            slope = float(self.gradient @ self.direction)
            if not value <= self.value + self.ENOUGH * self.step * slope + 1e-14 * abs(self.value):
                self.step /= 2
                self.done = self.step < self.LEAST_STEP
                self.trial = self.at + self.step * self.direction
                return
            moved, turned = self.trial - self.at, gradient - self.gradient
            if moved @ turned > 1e-14 * (turned @ turned):
                self.pairs = [*self.pairs[1 - self.MEMORY :], (moved, turned)]
        self.at, self.value, self.gradient = self.trial, value, gradient
        self.done = np.abs(gradient).max(initial=0) <= self.tolerance
        self.direction = -self._scaled(gradient)
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / max(1e-300, float(np.linalg.norm(gradient))))
        self.trial = self.at + self.step * self.direction

    def _scaled(self, gradient: np.ndarray) -> np.ndarray:
        """The gradient times the approximate inverse of the curvature that the pairs have."""
        q, shares = gradient.copy(), []
        for s, y in reversed(self.pairs):
            shares.append((s @ q) / (s @ y))
            q -= shares[-1] * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), share in zip(self.pairs, reversed(shares)):
            q += (share - (y @ q) / (s @ y)) * s
        return q


def minimised(evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """The minima of one smooth convex function for each row of start.

    evaluate takes a point for each function and returns all values and gradients, so that a round costs one pass over the
    data however many functions there are.
    """
    ways = [_Descent(row, tolerance) for row in start]
    for _ in range(rounds):
        values, gradients = evaluate(np.array([way.trial if not way.done else way.at for way in ways]))
        for way, value, gradient in zip(ways, values, gradients):
            if not way.done:
                way.told(float(value), gradient)
        if all(way.done for way in ways):
            break
    return np.array([way.at for way in ways])
