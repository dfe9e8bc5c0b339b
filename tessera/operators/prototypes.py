"""Prototype models: a mean for each class, distances to both, and a score from the two distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats
from .checkpoints import load_arrays, save_arrays, top_indices
from .passes import bounded_batches

DISTANCES = ("mahalanobis", "euclidean", "cosine")
COVARIANCES = ("bayes_ridge", "ledoit_wolf", "shared", "empirical", "per_class")
#: Dimensions up to which a covariance, d x d, comes to the driver; beyond, rows of at most so many bytes do.
COVARIANCE_DIMENSIONS = 4096
FACTOR_BYTES = 256 << 20


def ledoit_wolf_shrinkage(scatter: np.ndarray, n: float, fourth: float) -> float:
    """The share of the scaled identity that the Ledoit-Wolf estimate mixes in, from the sum of products of centred rows
    and the sum of the fourth powers of their norms."""
    return _shrinkage(len(scatter), np.trace(scatter) / n, ((scatter / n) ** 2).sum(), n, fourth)


def _shrinkage(d: int, trace: float, squares: float, n: float, fourth: float) -> float:
    if d == 1:
        return 0.0
    mean = trace / d
    between = (squares - d * mean**2) / d
    within = min((fourth / n - squares) / (d * n), between)
    return float(within / between) if within > 0 else 0.0


def precision(kind: str, scatter: np.ndarray, n: float, fourth: float, reg: float) -> np.ndarray:
    """The inverse covariance of n rows with a sum of products of centred rows."""
    d = len(scatter)
    if kind == "bayes_ridge":
        return d * np.linalg.inv(scatter + (np.trace(scatter) / max(n - 1, 1) + reg) * np.eye(d))
    covariance = scatter / n
    if kind in ("ledoit_wolf", "shared"):
        share = ledoit_wolf_shrinkage(scatter, n, fourth)
        covariance = (1 - share) * covariance + share * np.trace(covariance) / d * np.eye(d)
    return np.linalg.pinv(covariance, hermitian=True) + reg * np.eye(d)


class FactoredPrecision:
    """An inverse covariance of many dimensions from few rows: rest times the identity, and for each direction that the rows
    span, of which there are no more than rows, what it has beyond that.

    The directions come from the products of the rows with each other (their Gram matrix), by the identity that inverts a
    multiple of the identity plus a product of factors; no d x d array is made.
    """

    def __init__(self, kind: str, centred: np.ndarray, reg: float):
        n, d = centred.shape
        squares, turned = np.linalg.eigh(centred @ centred.T)
        some = squares > max(squares.max(initial=0), 0) * max(n, d) * np.finfo(float).eps
        squares = squares[some]
        self.directions = turned[:, some].T @ centred / np.sqrt(squares)[:, None]
        if kind == "bayes_ridge":
            ridge = squares.sum() / max(n - 1, 1) + reg
            self.rest, self.beyond = d / ridge, d / (squares + ridge) - d / ridge
            return
        share = 0.0
        if kind in ("ledoit_wolf", "shared"):
            fourth = ((centred * centred).sum(axis=1) ** 2).sum()
            share = _shrinkage(d, squares.sum() / n, ((squares / n) ** 2).sum(), n, fourth)
        floor = share * squares.sum() / n / d
        flat = 1 / floor if floor > 0 else 0.0  # a direction without variance has none in the pseudo-inverse
        self.rest, self.beyond = flat + reg, 1 / ((1 - share) * squares / n + floor) - flat

    def squared(self, z: np.ndarray) -> np.ndarray:
        """z' P z of each row z."""
        return self.rest * (z * z).sum(axis=1) + ((z @ self.directions.T) ** 2) @ self.beyond

    def arrays(self, k: int) -> dict[str, np.ndarray]:
        return {f"directions{k}": self.directions, f"beyond{k}": self.beyond, f"rest{k}": np.array(self.rest)}

    @classmethod
    def of_arrays(cls, arrays: dict[str, np.ndarray], k: int) -> "FactoredPrecision":
        out = cls.__new__(cls)
        out.directions, out.beyond, out.rest = arrays[f"directions{k}"], arrays[f"beyond{k}"], float(arrays[f"rest{k}"])
        return out


def scatters(xy: DataFrame, centres: np.ndarray) -> dict[int, tuple[np.ndarray, float, float]]:
    """For each class, the sum of products of its rows less its centre, their number, and the sum of the fourth powers of
    their norms. A task returns d + 1 rows for each class; these are added up by row."""
    d = centres.shape[1]
    shared = xy.sparkSession.sparkContext.broadcast(centres)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, fourth = np.zeros((2, d, d)), np.zeros(2), np.zeros(2)
        for batch in batches:
            lists = batch.column(0)
            x, y = np.asarray(lists.flatten(), float).reshape(-1, d), np.asarray(batch.column(1))
            for k in (0, 1):
                z = x[y == k] - shared.value[k]
                total[k] += z.T @ z
                n[k] += len(z)
                fourth[k] += ((z * z).sum(axis=1) ** 2).sum()
        for k in (0, 1):
            rows = [*total[k].tolist(), [n[k], fourth[k]]]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["y", "i", "v"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"y": rows["y"][:1], "i": rows["i"][:1], "v": [np.sum(rows["v"].tolist(), axis=0)]})

    schema = "y long, i long, v array<double>"
    rows = xy.select("x", F.col("y").cast("long")).mapInArrow(moments, schema).groupBy("y", "i").applyInPandas(added, schema).collect()
    out = {k: (np.zeros((d, d)), 0.0, 0.0) for k in (0, 1)}
    for row in rows:
        if row["i"] == d:
            out[row["y"]] = (out[row["y"]][0], *row["v"])
        else:
            out[row["y"]][0][row["i"]] = row["v"]
    return out


class Prototypes:
    """Fitted on rows (x, y) of both classes; scores() adds `score`, larger for class 1.

    The covariance is taken about the mean of all rows, or, for per_class, about each class's own. It is that of all rows, or
    of about covariance_rows of them (of each class, for per_class), chosen by a hash of run_id. Beyond COVARIANCE_DIMENSIONS
    dimensions it is that of no more rows than have FACTOR_BYTES, about their own mean.
    """

    def __init__(self, distance: str = "mahalanobis", covariance: str = "bayes_ridge", scoring: str = "softmax", reg: float = 1e-6, covariance_rows: int | None = None):
        if distance not in DISTANCES or covariance not in COVARIANCES or scoring not in ("softmax", "ratio", "raw"):
            raise ValueError(f"no such prototype model: {distance}, {covariance}, {scoring}")
        self.distance, self.covariance, self.scoring, self.reg = distance, covariance, scoring, reg
        self.covariance_rows = covariance_rows
        self.means: np.ndarray | None = None
        self.precisions: np.ndarray | None = None
        self.factored: list[FactoredPrecision] | None = None

    def clone(self) -> "Prototypes":
        return Prototypes(self.distance, self.covariance, self.scoring, self.reg, self.covariance_rows)

    def fit(self, xy: DataFrame) -> "Prototypes":
        rows = stats.class_means(xy).orderBy("i").collect()  # d rows
        if any(row[c] is None for row in rows for c in ("m0", "m1")) or not rows:
            raise ValueError("both classes are needed")
        self.means = np.array([[row[c] for row in rows] for c in ("m0", "m1")])
        self.precisions = self.factored = None
        if self.distance == "mahalanobis":
            if self.means.shape[1] > COVARIANCE_DIMENSIONS:
                self.factored = self._factored(xy)
            else:
                self.precisions = self._precisions(xy)
        return self

    def _chosen(self, xy: DataFrame, most: int | None) -> DataFrame:
        """About `most` of the rows, by a hash of the id."""
        n = xy.count() if most is not None else 0
        if most is None or n <= most:
            return xy
        return xy.where(F.pmod(F.xxhash64("run_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))

    def _factored(self, xy: DataFrame) -> list[FactoredPrecision]:
        d = self.means.shape[1]
        most = max(2, FACTOR_BYTES // (8 * d) // (2 if self.covariance == "per_class" else 1))
        most = min(most, self.covariance_rows or most)

        def of(rows: DataFrame, kind: str) -> FactoredPrecision:
            found = self._chosen(rows, most).select("run_id", "x").orderBy("run_id").limit(2 * most).toArrow()["x"].combine_chunks()
            x = np.asarray(found.flatten(), float).reshape(-1, d)
            return FactoredPrecision(kind, x - x.mean(axis=0), self.reg)

        if self.covariance == "per_class":
            return [of(xy.where(F.col("y") == k), "empirical") for k in (0, 1)]
        return [of(xy, self.covariance)] * 2

    def _precisions(self, xy: DataFrame) -> np.ndarray:
        if self.covariance == "per_class":
            if self.covariance_rows is None:
                return np.stack([precision("empirical", *of, self.reg) for _, of in sorted(scatters(xy, self.means).items())])
            some = self._chosen(xy.where("y = 0"), self.covariance_rows).unionByName(self._chosen(xy.where("y = 1"), self.covariance_rows))
            own = {row["y"]: row["m"] for row in stats.long_form(some, "y").groupBy("y", "i").agg(F.avg("v").alias("v")).groupBy("y").agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("m")).collect()}
            return np.stack([precision("empirical", *of, self.reg) for _, of in sorted(scatters(some, np.array([own[0], own[1]])).items())])
        if self.covariance_rows is not None:
            xy = self._chosen(xy, self.covariance_rows)
            rows = stats.long_form(xy).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()  # d rows
            centre = np.array([row["v"] for row in rows])
            of = scatters(xy, np.stack([centre, centre]))
            return np.stack([precision(self.covariance, *(of[0][k] + of[1][k] for k in range(3)), self.reg)] * 2)
        sizes = {row["y"]: row["count"] for row in xy.groupBy("y").count().collect()}
        centre = (sizes[0] * self.means[0] + sizes[1] * self.means[1]) / (sizes[0] + sizes[1])
        of = scatters(xy, np.stack([centre, centre]))
        both = [of[0][k] + of[1][k] for k in range(3)]
        return np.stack([precision(self.covariance, *both, self.reg)] * 2)

    def scores(self, xy: DataFrame) -> DataFrame:
        if self.factored:
            xy = bounded_batches(xy, self.means.shape[1])
        means = xy.sparkSession.createDataFrame([[m.tolist() for m in self.means]], "_m0 array<double>, _m1 array<double>")
        return self._scored(xy.join(F.broadcast(means))).select(*xy.columns, "score")  # one row

    def _scored(self, rows: DataFrame) -> DataFrame:
        """rows (x, _m0, _m1) with `score`."""
        s, u = (self._distance(F.col("x"), F.col(f"_m{k}"), k) for k in (0, 1))
        rows = rows.withColumn("_s", s).withColumn("_u", u)
        s, u = F.col("_s"), F.col("_u")
        if self.scoring == "ratio":
            score = s / (s + u + 1e-10)
        elif self.scoring == "softmax":
            a, b = -u * u / 2, -s * s / 2
            top = F.greatest(a, b)
            score = F.exp(a - top) / (F.exp(a - top) + F.exp(b - top))
        else:
            score = -u
        return rows.withColumn("score", score)

    def _distance(self, x: Column, mean: Column, k: int) -> Column:
        if self.distance == "cosine":
            return 1 - stats.cosine(x, mean, 1e-10)
        if self.distance == "euclidean":
            return stats.norm(F.zip_with(x, mean, lambda a, b: a - b))
        if self.factored:
            return self._factored_distance(x, k)
        inverse, centre = self.precisions[k], self.means[k]

        @F.pandas_udf("double")
        def distance(rows: pd.Series) -> pd.Series:
            z = np.array(rows.tolist(), float).reshape(len(rows), -1) - centre
            return pd.Series(np.sqrt(np.maximum(((z @ inverse) * z).sum(axis=1), 0)))

        return distance(x)

    def _factored_distance(self, x: Column, k: int) -> Column:
        shared = SparkSession.getActiveSession().sparkContext.broadcast((self.factored[k], self.means[k]))  # no more than FACTOR_BYTES

        @F.pandas_udf("double")
        def distance(rows: pd.Series) -> pd.Series:
            inverse, centre = shared.value
            return pd.Series(np.sqrt(np.maximum(inverse.squared(np.array(rows.tolist(), float).reshape(len(rows), -1) - centre), 0)))

        return distance(x)

    def held_out_scores(self, xy: DataFrame, by: str) -> DataFrame:
        """Scores of the rows of each value of `by`, which are few, by the means of all others: sums by value and class give
        the means of every fold at once, so the rows are read twice in all. For distances without a covariance."""
        sums = stats.long_form(xy, by, "y").groupBy(by, "i", "y").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
        folds = sums.select(F.col(by).alias("_held")).distinct()
        mean = lambda y: F.sum(F.when(F.col("y") == y, F.col("s"))) / F.sum(F.when(F.col("y") == y, F.col("n")))
        means = sums.join(F.broadcast(folds), F.col("_held") != F.col(by)).groupBy("_held", "i").agg(mean(0).alias("m0"), mean(1).alias("m1"))
        whole = lambda m: F.transform(F.array_sort(F.collect_list(F.struct("i", m))), lambda c: c[m])
        vectors = means.groupBy("_held").agg(whole("m0").alias("_m0"), whole("m1").alias("_m1"))
        return self._scored(xy.join(F.broadcast(vectors), F.col(by) == F.col("_held"))).select(*xy.columns, "score")

    def top_features(self, k: int, direction: str = "abs") -> list[int]:
        """Dimensions in which the classes differ most; positive is towards class 1."""
        return top_indices(self.means[1] - self.means[0], k, direction)

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = {"means": self.means} | ({} if self.precisions is None else {"precisions": self.precisions})
        for k, of in enumerate(self.factored or []):
            arrays |= of.arrays(k)
        save_arrays(spark, path, arrays, {"distance": self.distance, "covariance": self.covariance, "scoring": self.scoring, "reg": self.reg, "covariance_rows": self.covariance_rows})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Prototypes":
        arrays, settings = load_arrays(spark, path)
        model = cls(**settings)
        model.means, model.precisions = arrays["means"], arrays.get("precisions")
        model.factored = [FactoredPrecision.of_arrays(arrays, k) for k in (0, 1)] if "rest0" in arrays else None
        return model
