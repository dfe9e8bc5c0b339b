"""Boosted trees of second order: gradients and curvatures of the logistic loss, shrunken leaves, trees grown level by level.

Features are cut into bins once, at quantiles of their values, and the binned rows are stored. Each
level of a tree is one pass: tasks add up gradients and curvatures by node, feature and bin, Spark adds up the tasks' sums,
running sums along the bins give the gain of every cut, and the best cut of each node, a row a node, comes to the driver. What
leaves get follows from those sums, so that the deepest level needs no pass of its own. Rows find their node by walking the
tree so far; every REFRESHED trees the margins they have reached are stored with them, so that no row walks more trees than
that, and lineage ends there.

A gain is GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2), with sums of gradients brought towards 0 by l1 before; a leaf is
-G / (H + l2) times the rate. Ties go to the first feature and then the first cut. Rows whose vector or class is null count
nowhere and have no score; missing components count as 0. Without rows all scores are a half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import load_arrays, save_arrays, top_indices
from .passes import bounded_batches, matrix

#: A cut must gain more than this.
LEAST_GAIN = 1e-6
#: Trees after which the rows' margins are stored.
REFRESHED = 10
#: Cells of a level's sums that a task holds as one array; with more, a batch's cells are added up and handed on.
DENSE_CELLS = 1 << 22
#: Accuracy of quantiles where a feature has more distinct values than bins.
ACCURACY = 10_000

_HISTOGRAM = "node int, feature int, bin int, g double, h double"


@dataclass
class Tree:
    """Nodes as in a heap: node n has the children 2 n + 1 and 2 n + 2; feature -1 marks leaves. Rows below the cut go left."""

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        size = (2 << depth) - 1
        return cls(np.full(size, -1), np.zeros(size, int), np.zeros(size), np.zeros(size), np.zeros(size))

    def leaves(self, rows: np.ndarray, cuts: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each row: of features as bins with bin, of features as they come with cut; below at most so many levels."""
        node, at = np.zeros(len(rows), int), np.arange(len(rows))
        for _ in range((len(self.feature) + 1).bit_length() - 2 if levels is None else levels):
            feature = self.feature[node]
            right = rows[at, np.maximum(feature, 0)] >= cuts[node]
            node = np.where(feature >= 0, 2 * node + 1 + right, node)
        return node

    def of_bins(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        return self.leaves(bins, self.bin + 1, levels)


@dataclass(frozen=True)
class Settings:
    trees: int = 100
    depth: int = 6
    rate: float = 0.3
    l1: float = 0.0
    l2: float = 1.0
    least_child_weight: float = 1.0
    gamma: float = 0.0
    positive_weight: float = 1.0
    row_share: float = 1.0
    feature_share: float = 1.0
    bins: int = 256
    seed: int = 42
    normalize: str = "none"


@dataclass
class Boosted:
    """A classifier as in classify: fit() returns self, scores() adds the probability of class 1."""

    settings: Settings = field(default_factory=Settings)
    trees: list[Tree] = field(default_factory=list)
    width: int = 0
    means: np.ndarray | None = None
    scales: np.ndarray | None = None

    def clone(self) -> "Boosted":
        return Boosted(self.settings)

    def fit(self, xy: DataFrame, cuts: list[np.ndarray] | None = None, weight: str | None = None) -> "Boosted":
        """cuts: rising bounds of bins for each feature, instead of those that the rows give. weight: a column of row weights."""
        from ..sources.storage import removed, stored

        s = self.settings
        rows = xy.where("x IS NOT NULL AND y IS NOT NULL").select("run_id", "x", F.col("y").cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
        self.trees, self.width = [], rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
        self._set_scales(rows)
        if not self.width:
            return self
        cuts = cuts or quantile_cuts(rows.withColumn("x", self._prepared()("x")), self.width, s.bins)
        state, draw = stored(self._binned(rows, cuts)), np.random.default_rng(s.seed)
        pending: list[Tree] = []
        for number in range(s.trees):
            some = max(1, round(s.feature_share * self.width))
            features = np.sort(draw.permutation(self.width)[:some]) if s.feature_share < 1 else np.arange(self.width)
            pending.append(self._grown(state, pending, cuts, features, number))
            if len(pending) == REFRESHED and number + 1 < s.trees:
                self.trees, before = self.trees + pending, state
                state, pending = stored(_advanced(state, pending, self.width)), []
                removed(before)
        removed(state)
        self.trees += pending
        return self

    def _set_scales(self, rows: DataFrame) -> None:
        self.means, self.scales = np.zeros(self.width), np.ones(self.width)
        if self.settings.normalize == "standard":
            found = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).toArrow()
            at, s = np.asarray(found["i"]), np.asarray(found["s"])
            self.means[at], self.scales[at] = np.asarray(found["m"]), np.where(s > 0, s, 1)

    def _features(self, column: pa.Array) -> np.ndarray:
        rows = matrix(column, self.width)
        if self.settings.normalize == "l2":
            lengths = np.linalg.norm(rows, axis=1)
            rows = rows / np.where(lengths > 0, lengths, 1)[:, None]
        return (rows - self.means) / self.scales

    def _prepared(self):
        """The features as trees see them, as a function of a column."""
        if self.settings.normalize == "none":
            return F.col
        own = self

        @F.pandas_udf("array<double>")
        def prepared(x: pd.Series) -> pd.Series:
            return pd.Series([*own._features(pa.array(x, pa.list_(pa.float64())))])

        return prepared

    def _binned(self, rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
        """(u, y, w, margin, bins): u is a hash of the id, for draws of rows."""
        own, schema = self, "u long, y double, w double, margin double, bins array<int>"
        arrow = pa.schema([("u", pa.int64()), ("y", pa.float64()), ("w", pa.float64()), ("margin", pa.float64()), ("bins", pa.list_(pa.int32()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = own._features(batch.column("x"))
                bins = np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)], axis=1).astype(np.int32) if own.width else np.zeros((len(x), 0), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * own.width), pa.array(bins.ravel()))
                y = batch.column("y")
                w = np.asarray(batch.column("w")) * np.where(np.asarray(y) == 1, own.settings.positive_weight, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column("u"), y, pa.array(w), pa.array(np.zeros(len(x))), lists], schema=arrow)

        return bounded_batches(rows.select(F.xxhash64("run_id").alias("u"), "y", "w", "x"), self.width).mapInArrow(run, schema)

    def _grown(self, state: DataFrame, pending: list[Tree], cuts: list[np.ndarray], features: np.ndarray, number: int) -> Tree:
        s, tree = self.settings, Tree.empty(self.settings.depth)
        open_nodes = {0}
        for level in range(s.depth):
            found = best_cuts(histogram(state, pending, tree, level, self.width, features, s, number, max((len(c) for c in cuts), default=0) + 1), s).collect()  # a row for each node of the level
            deeper = set()
            for row in found:
                node = row["node"]
                if node not in open_nodes:
                    continue
                if level == 0:
                    tree.value[0] = s.rate * leaf(row["g"], row["h"], s)
                if row["best"] is None or row["best"]["gain"] <= max(LEAST_GAIN, s.gamma):
                    continue
                best = row["best"]
                tree.feature[node], tree.bin[node], tree.cut[node], tree.gain[node] = best["feature"], best["bin"], cuts[best["feature"]][best["bin"]], best["gain"]
                tree.value[2 * node + 1] = s.rate * leaf(best["gl"], best["hl"], s)
                tree.value[2 * node + 2] = s.rate * leaf(row["g"] - best["gl"], row["h"] - best["hl"], s)
                deeper |= {2 * node + 1, 2 * node + 2}
            open_nodes = deeper
            if not open_nodes:
                break
        return tree

    def margins(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for tree in self.trees:
            out += tree.value[tree.leaves(rows, tree.cut)]
        return out

    def scores(self, xy: DataFrame) -> DataFrame:
        own = self

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            known = x.notna().to_numpy()
            out = np.full(len(x), np.nan)
            out[known] = 1 / (1 + np.exp(-np.clip(own.margins(own._features(pa.array(x[known], pa.list_(pa.float64())))), -700, 700)))
            return pd.Series(out).where(pd.Series(known), None)

        return bounded_batches(xy, self.width).withColumn("score", score("x"))

    def weights(self) -> np.ndarray:
        """Each feature's mean gain over its cuts, as a share of all features' sum."""
        total, count = np.zeros(self.width), np.zeros(self.width)
        for tree in self.trees:
            cut = tree.feature >= 0
            np.add.at(total, tree.feature[cut], tree.gain[cut])
            np.add.at(count, tree.feature[cut], 1)
        mean = total / np.maximum(count, 1)
        return mean / (mean.sum() or 1)

    def top_features(self, k: int, direction: str = "abs") -> list[int]:
        """The dimensions of largest importance; importances have no sign, so every direction is abs."""
        return top_indices(self.weights(), k, "abs")

    def save(self, path: str) -> None:
        parts = {name: np.array([getattr(tree, name) for tree in self.trees], float) for name in ("feature", "bin", "cut", "value", "gain")}
        save_arrays(SparkSession.getActiveSession(), path, parts | {"means": self.means, "scales": self.scales}, vars(self.settings))

    def load(self, path: str) -> "Boosted":
        arrays, settings = load_arrays(SparkSession.getActiveSession(), path)
        parts = [arrays[name] for name in ("feature", "bin", "cut", "value", "gain")]
        trees = [Tree(f.astype(int), b.astype(int), *rest) for f, b, *rest in zip(*parts)]
        return Boosted(Settings(**settings), trees, len(arrays["means"]), arrays["means"], arrays["scales"])


def leaf(g: float, h: float, s: Settings) -> float:
    return -float(np.sign(g) * max(abs(g) - s.l1, 0) / (h + s.l2)) if h + s.l2 > 0 else 0.0


def quantile_cuts(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """For each feature the rising values at which bins begin: its distinct quantiles, bins - 1 at most.

    They are the model's: no more than features x bins come to the driver.
    """
    cells = rows.select(F.posexplode("x").alias("i", "v")).select("i", F.coalesce("v", F.lit(0.0)).alias("v"))
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    of = cells.groupBy("i").agg(F.sort_array(F.array_distinct(F.percentile_approx("v", at, ACCURACY))).alias("cuts")).collect()
    cuts = {row["i"]: np.array(row["cuts"]) for row in of}
    return [cuts.get(i, np.zeros(0)) for i in range(width)]


def _reached(batch: pa.RecordBatch, trees: list[Tree], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins of a batch and the margins with these trees."""
    bins, margins = matrix(batch.column("bins"), width, np.int32), np.asarray(batch.column("margin"))
    for tree in trees:
        margins = margins + tree.value[tree.of_bins(bins)]
    return bins, margins


def _advanced(state: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(_reached(batch, trees, width)[1]))

    return bounded_batches(state, width).mapInArrow(run, state.schema)


def _drawn(u: np.ndarray, share: float, seed: int, number: int) -> np.ndarray:
    """Whether a row is in a tree's share of the rows, by its hash."""
    mixed = (u.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B1 + number)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(11)) / float(1 << 53) < share


def histogram(state: DataFrame, pending: list[Tree], tree: Tree, level: int, width: int, features: np.ndarray, s: Settings, number: int, most_bins: int) -> DataFrame:
    """Sums of gradients and curvatures by node of a level, feature and bin: a row a task for each that has rows."""
    nodes, base = 1 << level, (1 << level) - 1
    schema = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.float64()), ("h", pa.float64())])
    cells = nodes * len(features) * most_bins

    def rows(keys: np.ndarray, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        node, rest = np.divmod(keys, len(features) * most_bins)
        feature, own = np.divmod(rest, most_bins)
        return pa.RecordBatch.from_arrays([pa.array((node + base).astype(np.int32)), pa.array(features[feature].astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(g), pa.array(h)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, cells)) if cells <= DENSE_CELLS else None
        for batch in batches:
            bins, margins = _reached(batch, pending, width)
            node = tree.of_bins(bins, level) - base
            take = node >= 0
            if s.row_share < 1:
                take &= _drawn(np.asarray(batch.column("u")), s.row_share, s.seed, number)
            p, w = 1 / (1 + np.exp(-np.clip(margins, -700, 700))), np.asarray(batch.column("w"))
            g, h = (w * (p - np.asarray(batch.column("y"))))[take], (w * p * (1 - p))[take]
            keys = ((node[take][:, None] * len(features) + np.arange(len(features))) * most_bins + bins[take][:, features]).ravel()
            g, h = np.repeat(g, len(features)), np.repeat(h, len(features))
            if total is not None:
                total += np.stack([np.bincount(keys, of, cells) for of in (g, h)])
            elif len(keys):
                own, back = np.unique(keys, return_inverse=True)
                yield rows(own, np.bincount(back, g), np.bincount(back, h))
        if total is not None:
            keys = np.flatnonzero(total[1] > 0)
            yield rows(keys, *total[:, keys])

    return bounded_batches(state, width).mapInArrow(run, _HISTOGRAM)


def best_cuts(sums: DataFrame, s: Settings) -> DataFrame:
    """(node, g, h, best): each node's sums, and the feature, bin, gain and left sums of its best cut; rows of bins up to that
    one go left. Null where no cut leaves enough on both sides."""
    score = lambda g, h: f"CASE WHEN {h} + {s.l2!r} > 0 THEN power(greatest(abs({g}) - {s.l1!r}, 0), 2) / ({h} + {s.l2!r}) ELSE 0 END"
    # what is right of the last bin is nothing, but for rounding
    return sums.sparkSession.sql(
        f"""
        WITH dealt AS (SELECT /*+ REPARTITION(node, feature) */ * FROM {{sums}}),
             cells AS (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h FROM dealt GROUP BY node, feature, bin),
             running AS (SELECT node, feature, bin, sum(g) OVER (PARTITION BY node, feature ORDER BY bin) AS gl, sum(h) OVER (PARTITION BY node, feature ORDER BY bin) AS hl,
                                sum(g) OVER (PARTITION BY node, feature) AS g, sum(h) OVER (PARTITION BY node, feature) AS h FROM cells),
             sides AS (SELECT *, g - gl AS gr, h - hl AS hr FROM running),
             cuts AS (SELECT *, {score("gl", "hl")} + {score("gr", "hr")} - {score("g", "h")} AS gain, hl >= {s.least_child_weight!r} AND hr >= {s.least_child_weight!r} AND hr > 1e-12 * h AS able FROM sides)
        SELECT node, max(g) AS g, max(h) AS h, max_by(struct(feature, bin, gain, gl, hl), CASE WHEN able THEN struct(round(gain, 9) AS a, -feature AS b, -bin AS c) END) FILTER (WHERE able) AS best
        FROM cuts GROUP BY node""",
        sums=sums,
    )
