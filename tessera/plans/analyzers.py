"""Analyzers: what belongs together over one table, run at once, and its results written as JSON and CSV."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matrix as M
from ..operators import stats as S
from ..operators import unsupervised as U
from ..sources import storage


class _Saving:
    """save_results() writes each table of the results below a folder, arrays in NumPy's format, the other values as JSON."""

    def save_results(self, results: dict, folder: str) -> None:
        spark = next(value for value in results.values() if isinstance(value, DataFrame)).sparkSession
        plain = {}
        for name, value in results.items():
            if isinstance(value, np.ndarray):
                storage.write_npy(spark, f"{folder}/{name}.npy", value)
            elif not isinstance(value, DataFrame):
                plain[name] = value
            elif any(kind.startswith(("array", "struct", "map")) for _, kind in value.dtypes):
                storage.write_json(value, f"{folder}/{name}.json")
            else:
                storage.write_csv(value, f"{folder}/{name}.csv")
        storage.write_bytes(spark, f"{folder}/summary.json", json.dumps(plain, default=str).encode())


class ComparisonAnalyzer(_Saving):
    """Frequencies of the top features, how often two meet, and their mutual information."""

    def __init__(self, top_k: int = 200, most: float = 1.0):
        self.top_k, self.most = top_k, most

    def run(self, incidence: DataFrame) -> dict:
        n_runs = incidence.select("run_id").distinct().count()
        frequency = M.feature_frequency(incidence)
        matrix = storage.stored(M.feature_matrix(incidence, self.top_k, "binary", self.most))
        top = M.top_features(M.not_ubiquitous(frequency, n_runs, self.most), self.top_k)
        return {"n_runs": n_runs, "frequency": top, "summary": S.frequency_summary(top), "pmi": S.pmi(matrix, n_runs), "matrix": matrix}


class DirectionsAnalyzer(_Saving):
    """The direction between two classes, how well it tells them, and the histogram of projections on it."""

    def __init__(self, bins: int = 50):
        self.bins = bins

    def run(self, xy: DataFrame) -> dict:
        direction = storage.stored(S.direction(xy))
        projected = S.projection(xy, direction)
        vector = np.array([row["d"] for row in direction.orderBy("i").collect()])  # a value for each dimension
        return {"direction": direction, "vector": vector, "separability": S.separability(xy), "projections": projected, "histogram": S.histogram(projected, "s", self.bins)}

    def run_pairwise(self, xy: DataFrame, datasets: list) -> dict:
        """run() of the positives of each pair of datasets, the first one's as class 0; datasets are few."""
        out = {}
        for at, a in enumerate(datasets):
            for b in datasets[at + 1 :]:
                both = xy.where((F.col("y") == 1) & F.col("dataset_id").isin(a, b)).withColumn("y", (F.col("dataset_id") == b).cast("long"))
                out[a, b] = self.run(both)
        return out


class UnsupervisedAnalyzer(_Saving):
    """Standardised vectors, their principal components, clusters of these and the silhouette.

    The silhouette is null with one cluster or at most ten rows.
    """

    def __init__(self, n_components: int = 50, clustering: str = "kmeans", n_clusters: int = 5, eps: float = 0.5, least: int = 5, standardize: bool = True, seed: int = 42):
        if clustering not in ("kmeans", "dbscan"):
            raise ValueError(f"no such clustering: {clustering}")
        self.n_components, self.clustering, self.n_clusters, self.eps, self.least, self.standardize, self.seed = n_components, clustering, n_clusters, eps, least, standardize, seed

    def run(self, rows: DataFrame) -> dict:
        """rows: (run_id, x)."""
        n, d = (rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first())
        ready = _whole(S.standardized(rows)) if self.standardize else rows.select("run_id", "x")
        z, explained = U.pca(ready, min(self.n_components, n, d))
        reduced = storage.stored(z.select("run_id", F.col("z").alias("x")))
        if self.clustering == "kmeans":
            clustered = U.kmeans(reduced, self.n_clusters, seed=self.seed)
        else:
            clustered = reduced.join(U.dbscan(reduced, self.eps, self.least, storage.stored), "run_id")
        clustered = storage.stored(clustered.select("run_id", "x", F.col("cluster").cast("long").alias("cluster")))
        return {
            "n_prompts": n,
            "n_features": d,
            "explained_variance": explained,
            "cumulative_variance": U.cumulative(explained),
            "clusters": clustered,
            "cluster_sizes": clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")),
            "centers": S.centroids(clustered.where("cluster >= 0"), "cluster"),
            "silhouette": U.silhouette(clustered).first()["silhouette"],
        }

    def run_on_features(self, cells: DataFrame, width: int) -> dict:
        """cells: (run_id, i, v) of a matrix with i below width; absent cells are 0."""
        return self.run(dense(cells, width))

    def run_on_activations(self, vectors: DataFrame) -> dict:
        return self.run(vectors)


def _whole(cells: DataFrame) -> DataFrame:
    """(run_id, x) from every cell (run_id, i, v) of dense rows."""
    return cells.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("x"))


def dense(cells: DataFrame, width: int) -> DataFrame:
    """(run_id, x) with zeros where a cell is absent; cells given twice add up."""
    by_run = cells.groupBy("run_id", "i").agg(F.sum("v").alias("v")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("int"), "v"))).alias("m"))
    return by_run.select("run_id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("x"))


#: Analyzers by their configured names.
BY_NAME: dict[str, Callable] = {"comparison": ComparisonAnalyzer, "directions": DirectionsAnalyzer, "unsupervised": UnsupervisedAnalyzer}
