"""Principal components of vectors of any width, by a randomised search for the space of the leading ones.

A block of k + EXTRA directions is multiplied with the covariance again and again, each time in one pass over the rows, and
made orthonormal between passes; what the covariance does within the block then gives the components. The largest thing
anywhere is the block, width x (k + EXTRA): no task and no driver holds a matrix of width x width. Rows come as arrays, or as
the coordinates of what is not zero, which are never filled up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passes import bounded_batches, matrix, summed

#: Directions beyond those asked for, most passes, and the share by which leading variances may still grow at the end.
EXTRA, ROUNDS, SETTLED = 10, 30, 1e-4
#: Cells times directions that are multiplied at once.
PRODUCTS = 1 << 21


class Rows:
    """A batch of rows, dense or by coordinates, that is multiplied from either side."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.width, self.number = width, batch.num_rows
        if "feature_idx" not in batch.schema.names:
            self.dense = matrix(batch.column("x"), width)
            return
        self.dense = None
        lists = batch.column("feature_idx")
        self.row = np.repeat(np.arange(self.number), np.asarray(lists.value_lengths().fill_null(0), np.int64))
        self.column, self.value = np.asarray(lists.flatten(), np.int64), np.asarray(batch.column("v").flatten(), float)

    def __matmul__(self, block: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense @ block
        out, step = np.zeros((self.number, block.shape[1])), max(1, PRODUCTS // block.shape[1])
        for at in range(0, len(self.value), step):
            some = slice(at, at + step)
            np.add.at(out, self.row[some], self.value[some, None] * block[self.column[some]])
        return out

    def left(self, weights: np.ndarray) -> np.ndarray:
        """weights' transpose times the rows: a row for each column of weights."""
        if self.dense is not None:
            return weights.T @ self.dense
        return np.stack([np.bincount(self.column, self.value * own[self.row], self.width) for own in weights.T])

    def sums(self) -> np.ndarray:
        return self.left(np.ones((self.number, 1)))[0]

    def squares(self) -> float:
        return float(((self.dense if self.dense is not None else self.value) ** 2).sum())


@dataclass(frozen=True)
class Components:
    """Orthonormal components as rows, the variances along them, that of all dimensions, and the mean."""

    components: np.ndarray
    variances: np.ndarray
    total: float
    mean: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else np.zeros(len(self.variances))

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with `z`, their components; null for a null vector. The components go to each worker once."""
        shared = rows.sparkSession.sparkContext.broadcast((self.components.T.copy(), self.components @ self.mean))
        width, columns = len(self.mean), _columns(rows)

        @F.pandas_udf("array<double>")
        def project(part: pd.DataFrame) -> pd.Series:
            block, shift = shared.value
            known = part[columns[0]].notna()
            kinds = {"feature_idx": pa.list_(pa.int64()), "v": pa.list_(pa.float64()), "x": pa.list_(pa.float64())}
            batch = pa.record_batch({name: pa.array(part.loc[known, name], kinds[name]) for name in columns})
            found = iter(Rows(batch, width) @ block - shift)
            return pd.Series([next(found) if one else None for one in known], dtype=object)

        return bounded_batches(rows, width).withColumn("z", project(F.struct(*columns)))


def _columns(rows: DataFrame) -> list[str]:
    return ["feature_idx", "v"] if "feature_idx" in rows.columns else ["x"]


def by_coordinates(cells: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, feature_idx, v) with arrays, from a row for each cell that is not zero; cells given twice add up."""
    return cells.groupBy(key).agg(F.collect_list(F.col("feature_idx").cast("long")).alias("feature_idx"), F.collect_list(F.col("v").cast("double")).alias("v"))


def components(rows: DataFrame, k: int, width: int | None = None, seed: int = 42) -> Components:
    """The first k principal components of rows (x), or (feature_idx, v) with arrays of the coordinates that are not zero.

    Null vectors take no part; shorter ones have zeros on the right. Fewer rows or dimensions than k leave components
    without variance.
    """
    columns = _columns(rows)
    rows = rows.where(F.col(columns[0]).isNotNull()).select(*columns)
    if width is None:
        longest = F.max(F.size("x")) if columns == ["x"] else F.max(F.array_max("feature_idx")) + 1
        width = rows.agg(F.coalesce(longest, F.lit(0))).first()[0]
    k = min(k, width)

    def first(batch: pa.RecordBatch) -> np.ndarray:
        own = Rows(batch, width)
        return np.concatenate([own.sums(), [own.number, own.squares()]])[None]

    whole = summed(rows, width, first, (1, width + 2))[0]
    n = max(whole[width], 1.0)
    mean = whole[:width] / n
    total = max(whole[width + 1] / n - float(mean @ mean), 0.0)
    size = min(width, k + EXTRA)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    before = np.zeros(k)
    for _ in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def product(batch: pa.RecordBatch) -> np.ndarray:
            own, block = Rows(batch, width), shared.value
            along = own @ block - mean @ block
            return own.left(along) - along.sum(axis=0)[:, None] * mean

        image = summed(rows, width, product, (size, width)).T / n  # the covariance times the block
        shared.destroy()
        values, turned = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        found = block @ turned
        settled = (np.abs(values[:k] - before) <= SETTLED * np.maximum(values[:k], 1e-300)).all()
        before = values[:k]
        if settled or size == width:
            break
        block = np.linalg.qr(image @ turned)[0]
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])]) if width else np.zeros(0)
    return Components((found * signs).T[:k], np.maximum(before, 0), float(total), mean)
