"""Classifiers over (run_id, x array<double>, y, dataset_id): linear, boosted and neural models, their protocol, and folds.

What crosses to the driver are model parameters: coefficients, means, a covariance of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import MaxAbsScaler, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .boosting import Boosted
from .boosting import Settings as BoostSettings
from .checkpoints import coefficient_rows, load_arrays, save_arrays, top_indices
from .folds import NORMALIZATIONS, Folds, fit_folds
from .prototypes import Prototypes


class Classifier(Protocol):
    """fit() returns self; scores() adds `score`, larger for class 1; clone() is an unfitted copy."""

    def fit(self, xy: DataFrame) -> "Classifier": ...

    def scores(self, xy: DataFrame) -> DataFrame: ...

    def clone(self) -> "Classifier": ...


def balanced(xy: DataFrame) -> DataFrame:
    """xy with `w`: n / (2 n of the row's class)."""
    sizes = xy.groupBy("y").agg(F.count(F.lit(1)).alias("n_y"))
    total = sizes.agg(F.sum("n_y").alias("n"))
    return xy.join(F.broadcast(sizes.join(F.broadcast(total)).select("y", (F.col("n") / (2.0 * F.col("n_y"))).alias("w"))), "y")


class _Wrapped:
    """A pyspark.ml pipeline of a scaler and a model."""

    def __init__(self, make: Callable[[int], list], weighted: bool = False):
        self.make, self.weighted, self.model = make, weighted, None

    def clone(self) -> "_Wrapped":
        return _Wrapped(self.make, self.weighted)

    def fit(self, xy: DataFrame) -> "_Wrapped":
        rows = balanced(xy) if self.weighted else xy
        rows = rows.withColumn("raw", array_to_vector("x")).withColumn("label", F.col("y").cast("double"))
        self.model = Pipeline(stages=self.make(xy.count())).fit(rows)
        return self

    def scores(self, xy: DataFrame) -> DataFrame:
        out = self.model.transform(xy.withColumn("raw", array_to_vector("x")))
        return out.select(*xy.columns, vector_to_array("probability")[1].alias("score"))

    def weights(self) -> np.ndarray:
        """A linear model's coefficients, a boosted one's importances."""
        fitted = self.model.stages[-1]
        return (fitted.coefficients if hasattr(fitted, "coefficients") else fitted.featureImportances).toArray()

    def top_features(self, k: int, direction: str = "positive") -> list[int]:
        """The dimensions of largest weight; importances have no sign, so there every direction is abs."""
        return top_indices(self.weights(), k, direction if hasattr(self.model.stages[-1], "coefficients") else "abs")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> "_Wrapped":
        """A model of this kind as save() left it."""
        out = self.clone()
        out.model = PipelineModel.load(path)
        return out


class Linear(_Wrapped):
    """Logistic regression with balanced classes; its penalty is 1 / (c n), or 1 / c as a stochastic solver counts it.

    normalize: rows to length 1 (l2, or True), features to mean 0 and deviation 1 over the rows it is fitted on (standard),
    or none (or False).
    """

    def __init__(self, c: float = 1.0, normalize: bool | str = True, iterations: int = 200, sgd: bool = False):
        self.c, self.iterations, self.sgd = c, iterations, sgd
        self.normalize = {True: "l2", False: "none"}.get(normalize, normalize)
        if self.normalize not in NORMALIZATIONS:
            raise ValueError(f"no such normalization: {normalize}")
        self.folds: Folds | None = None
        scaler = [Normalizer(inputCol="raw", outputCol="features", p=2.0)] if self.normalize == "l2" else []
        column = "features" if scaler else "raw"
        super().__init__(lambda n: [*scaler, LogisticRegression(featuresCol=column, weightCol="w", regParam=1 / c if sgd else 1 / (c * n), standardization=False, maxIter=iterations, tol=1e-9)], weighted=True)

    def clone(self) -> "Linear":
        return Linear(self.c, self.normalize, self.iterations, self.sgd)

    def fit(self, xy: DataFrame) -> "Linear":
        if self.normalize != "standard":
            return super().fit(xy)
        self.folds = fit_folds(xy, None, self.c, self.normalize, self.sgd, self.iterations)
        return self

    def fit_folds(self, xy: DataFrame, group: str) -> Folds:
        """This model of all rows and without each group, fitted together."""
        return fit_folds(xy, group, self.c, self.normalize, self.sgd, self.iterations)

    def scores(self, xy: DataFrame) -> DataFrame:
        return self.folds.scores(xy, None) if self.normalize == "standard" else super().scores(xy)

    def weights(self) -> np.ndarray:
        return self.folds.coefficients[0] if self.normalize == "standard" else super().weights()

    def top_features(self, k: int, direction: str = "positive") -> list[int]:
        return top_indices(self.weights(), k, direction)

    def save(self, path: str) -> None:
        if self.normalize != "standard":
            return super().save(path)
        own = self.folds
        save_arrays(SparkSession.getActiveSession(), path, {"coefficients": own.coefficients, "intercepts": own.intercepts, "means": own.means, "scales": own.scales}, {"l2": own.l2})

    def load(self, path: str) -> "Linear":
        if self.normalize != "standard":
            return super().load(path)
        out = self.clone()
        arrays, settings = load_arrays(SparkSession.getActiveSession(), path)
        out.folds = Folds([], **arrays, **settings)
        return out


def linear(c: float = 1.0, normalize: bool | str = True, iterations: int = 200, sgd: bool = False) -> Linear:
    return Linear(c, normalize, iterations, sgd)


def boosted(trees: int = 20, depth: int = 6, rate: float = 0.3, **settings) -> Boosted:
    """Trees of second order; the other settings are those of boosting.Settings, which by themselves mean 100 trees. Here there
    are fewer unless told, as each level of a tree is a job."""
    return Boosted(BoostSettings(trees, depth, rate, **settings))


def neural(layers: tuple[int, ...], iterations: int = 50, seed: int = 42) -> _Wrapped:
    """A perceptron on features scaled by their largest magnitude: the adversarial network at domain weight 0."""
    return _Wrapped(lambda n: [MaxAbsScaler(inputCol="raw", outputCol="features"), MultilayerPerceptronClassifier(featuresCol="features", layers=list(layers), maxIter=iterations, seed=seed)])


def with_fold(rows: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """rows with `fold`: a shuffled k-fold split by a hash of the id, so every row's fold is its own matter."""
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("run_id").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("long"))


#: Hexadecimal digits of the hash that name a cell of the stratified split.
CELL_DIGITS = 3


def stratified_split(rows: DataFrame, test_share: float, seed: int = 42) -> DataFrame:
    """rows with `part`, train or test: of each class the first by a hash of the id are the test part.

    Ranks go in two levels, within cells of hashes and by the counts of the cells before, so that a class, of which there
    are few, is in many tasks. Cells are so many a class at any size.
    """
    key = F.md5(F.concat_ws("|", F.col("run_id").cast("string"), F.lit(str(seed))))
    dealt = rows.withColumn("_key", key).withColumn("_cell", F.substring("_key", 1, CELL_DIGITS))
    cells = dealt.groupBy("y", "_cell").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("y").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.select("y", "_cell", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy("y")).alias("_n"))
    within = F.row_number().over(Window.partitionBy("y", "_cell").orderBy("_key", "run_id"))
    ranked = dealt.withColumn("_k", within).join(sums, ["y", "_cell"]).withColumn("_k", F.col("_k") + F.col("_before"))
    return ranked.withColumn("part", F.when(F.col("_k") <= F.floor(F.col("_n") * test_share), "test").otherwise("train")).select(*rows.columns, "part")


def out_of_fold(classifier: Classifier, xy: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """Scores of every row by a model that hasn't seen it; prototypes and linear models of all folds at once, else a loop
    over folds, which are few."""
    dealt = with_fold(xy, folds, seed)
    if isinstance(classifier, Linear):
        return classifier.fit_folds(dealt, "fold").scores(dealt, "fold")
    if isinstance(classifier, Prototypes) and classifier.distance != "mahalanobis":
        return classifier.held_out_scores(dealt, "fold")
    out = None
    for k in range(folds):
        model = classifier.clone().fit(dealt.where(F.col("fold") != k).drop("fold"))
        part = model.scores(dealt.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def lodo_scores(classifier: Classifier, xy: DataFrame) -> DataFrame:
    """Leave one dataset out: scores of each dataset by a model fitted on the others; prototypes and linear models of all
    datasets at once, else a loop over datasets, which are few."""
    if isinstance(classifier, Linear):
        return classifier.fit_folds(xy, "dataset_id").scores(xy, "dataset_id")
    if isinstance(classifier, Prototypes) and classifier.distance != "mahalanobis":
        return classifier.held_out_scores(xy, "dataset_id")
    out = None
    for row in xy.select("dataset_id").distinct().orderBy("dataset_id").collect():
        held = row["dataset_id"]
        model = classifier.clone().fit(xy.where(F.col("dataset_id") != held))
        part = model.scores(xy.where(F.col("dataset_id") == held))
        out = part if out is None else out.unionByName(part)
    return out


def lodo_coefficients(classifier: _Wrapped, xy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, coef) of a model of all rows, and (dataset_id, i, coef) of one for each dataset held out: d rows a fold. Linear
    models are fitted together, others one by one."""
    spark = xy.sparkSession
    if isinstance(classifier, Linear):
        folds = classifier.fit_folds(xy, "dataset_id")
        return folds.baseline(spark), folds.held_out(spark)
    names = [row["dataset_id"] for row in xy.select("dataset_id").distinct().orderBy("dataset_id").collect()]
    baseline = coefficient_rows(spark, classifier.clone().fit(xy).weights())
    held = None
    for name in names:
        part = coefficient_rows(spark, classifier.clone().fit(xy.where(F.col("dataset_id") != name)).weights()).select(F.lit(name).alias("dataset_id"), "i", "coef")
        held = part if held is None else held.unionByName(part)
    return baseline, held


def merged_datasets(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Datasets that count as one get one name."""
    if not names:
        return rows
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rows.withColumn("dataset_id", F.coalesce(table[F.col("dataset_id").cast("string")], F.col("dataset_id").cast("string")))
