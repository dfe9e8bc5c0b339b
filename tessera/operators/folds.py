"""Linear models of all folds at once: every step of every model comes from the same pass over the data.

A model for each group of rows that is held out, and one of all rows. A task multiplies its vectors with the coefficients of
all models together; a row counts in every model but that of its own group. So passes are as many as the slowest model needs
steps, at any number of groups; coefficients, groups x dimensions, are what crosses to the driver.

Means and deviations for features brought to one scale come from sums by group, which a model's own are all sums less those of
its group. Rows whose vector or class is null count nowhere and have no score; a group of null is a group. A model that sees
one class only keeps coefficients of 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import coefficient_rows
from .passes import bounded_batches, matrix, minimised, summed

NORMALIZATIONS = ("l2", "standard", "none")


@dataclass(frozen=True)
class Folds:
    """The model of all rows, and then one for each group that is held out; a group that wasn't there has the first."""

    groups: list
    coefficients: np.ndarray
    intercepts: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    l2: bool

    def linear(self) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and intercepts for features as they come."""
        raw = self.coefficients / self.scales
        return raw, self.intercepts - (raw * self.means).sum(axis=1)

    def baseline(self, spark) -> DataFrame:
        """(i, coef) of the model of all rows."""
        return coefficient_rows(spark, self.coefficients[0])

    def held_out(self, spark, names: str = "dataset_id") -> DataFrame:
        """(group, i, coef) of the others."""
        kind = next(("long" if isinstance(g, int) else "double" if isinstance(g, float) else "string" for g in self.groups if g is not None), "string")
        rows = [(group, i, float(c)) for group, own in zip(self.groups, self.coefficients[1:]) for i, c in enumerate(own)]
        return spark.createDataFrame(rows, f"{names} {kind}, i long, coef double")

    def scores(self, xy: DataFrame, group: str | None) -> DataFrame:
        """xy with `score` by the model that hasn't seen the row's group; by the model of all rows without one."""
        number = {g: at for at, g in enumerate(self.groups, 1)}
        weights, intercepts, width, l2 = *self.linear(), self.coefficients.shape[1], self.l2
        column = group or "x"

        @F.pandas_udf("double")
        def score(x: pd.Series, groups: pd.Series) -> pd.Series:
            known = x.notna().to_numpy()
            features = _scaled(matrix(pa.array(x[known], pa.list_(pa.float64())), width), l2)
            which = np.array([number.get(g, 0) for g in _plain(groups[known])], int) if group else np.zeros(len(features), int)
            out = np.full(len(x), np.nan)
            margins = _by_model(features, weights, which) + intercepts[which]
            out[known] = 1 / (1 + np.exp(-np.clip(margins, -700, 700)))
            return pd.Series(out).where(pd.Series(known), None)

        return bounded_batches(xy, width).withColumn("score", score("x", column))


def _plain(groups: pd.Series) -> list:
    """Groups as Python values, missing ones as None."""
    return [None if g is None or g != g else g for g in groups.tolist()]


def _by_model(features: np.ndarray, weights: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Each row's product with its own model's weights, model by model."""
    out = np.empty(len(features))
    for model in np.unique(which):
        own = which == model
        out[own] = features[own] @ weights[model]
    return out


def _scaled(rows: np.ndarray, l2: bool) -> np.ndarray:
    if not l2:
        return rows
    lengths = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(lengths > 0, lengths, 1)[:, None]


def fit_folds(xy: DataFrame, group: str | None = "dataset_id", c: float = 1.0, normalize: str = "l2", sgd: bool = False, rounds: int = 200, tolerance: float = 1e-7) -> Folds:
    """Logistic regressions with balanced classes over (x, y, group); the penalty of coefficients is 1 / (c n), n being a
    model's rows, or 1 / c as a stochastic solver counts it. group None fits the model of all rows only."""
    if normalize not in NORMALIZATIONS:
        raise ValueError(f"no such normalization: {normalize}")
    rows = xy.where("x IS NOT NULL AND y IS NOT NULL").select("x", F.col("y").cast("int").alias("y"), (F.col(group) if group else F.lit(0)).alias("g"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), F.max(F.size("x")).alias("width")).orderBy("g").collect()  # a row for each group
    names = [row["g"] for row in sizes] if group else []
    width = max((row["width"] for row in sizes), default=0)
    number = {name: at for at, name in enumerate([row["g"] for row in sizes])}
    counts = np.array([[row["n"] - row["ones"], row["ones"]] for row in sizes], float).reshape(-1, 2)
    held = np.vstack([np.zeros((1, len(sizes)), bool), np.eye(len(sizes), dtype=bool)]) if group else np.zeros((1, len(sizes)), bool)
    models, own = len(held), ~held @ counts  # rows of each class that each model sees
    n, l2 = own.sum(axis=1), normalize == "l2"
    means, scales = _scales(rows, width, number, held, n) if normalize == "standard" else (np.zeros((models, width)), np.ones((models, width)))
    class_weight = np.where(own > 0, n[:, None] / (2 * np.maximum(own, 1)), 0)
    able = (own > 0).all(axis=1)
    penalty = np.full(models, 1 / c) if sgd else 1 / (c * np.maximum(n, 1))

    def evaluate(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = points[:, :width] / scales
        offsets = points[:, width] - (raw * means).sum(axis=1)

        def sums(batch: pa.RecordBatch) -> np.ndarray:
            features = _scaled(matrix(batch.column("x"), width), l2)
            y, g = np.asarray(batch.column("y")), np.array([number[v] for v in batch.column("g").to_pylist()], int)
            margins = features @ raw.T + offsets
            weights = class_weight[:, y].T * ~held[:, g].T
            residuals = weights * (1 / (1 + np.exp(-np.clip(margins, -700, 700))) - y[:, None])
            losses = weights * (np.logaddexp(0, margins) - y[:, None] * margins)
            return np.hstack([residuals.T @ features, residuals.sum(axis=0)[:, None], losses.sum(axis=0)[:, None]])

        total = summed(rows, width, sums, (models, width + 2)) / np.maximum(n, 1)[:, None]
        slopes = (total[:, :width] - means * total[:, width : width + 1]) / scales + penalty[:, None] * points[:, :width]
        values = total[:, width + 1] + penalty / 2 * (points[:, :width] ** 2).sum(axis=1)
        return np.where(able, values, 0), np.where(able[:, None], np.hstack([slopes, total[:, width : width + 1]]), 0)

    found = minimised(evaluate, np.zeros((models, width + 1)), rounds, tolerance) if able.any() else np.zeros((models, width + 1))
    return Folds(names, found[:, :width], found[:, width], means, scales, l2)


def _scales(rows: DataFrame, width: int, number: dict, held: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the deviation of each dimension over the rows that each model sees, from two passes of sums by group."""

    def by_group(shift: np.ndarray, power: int) -> np.ndarray:
        def sums(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((len(number), width))
            np.add.at(out, [number[v] for v in batch.column("g").to_pylist()], (matrix(batch.column("x"), width) - shift) ** power)
            return out

        return ~held @ summed(rows, width, sums, (len(number), width)) / np.maximum(n, 1)[:, None]

    center = by_group(np.zeros(width), 1)[0]
    moved = by_group(center, 1)
    deviations = np.sqrt(np.maximum(by_group(center, 2) - moved**2, 0))
    return center + moved, np.where(deviations > 0, deviations, 1.0)
