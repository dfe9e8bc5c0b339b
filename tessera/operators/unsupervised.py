"""Projections and clusters: PCA, K-means, density clusters and silhouettes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats
from .passes import bounded_batches, matrix, summed


def pca(xy: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """xy with `z`, the k components of its centred vectors, and the variance each explains."""
    rows = xy.withColumn("_v", array_to_vector("x"))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_c", outputCol="_z").fit(centred)
    return model.transform(centred).withColumn("z", vector_to_array("_z")).drop("_v", "_c", "_z"), [float(v) for v in model.explainedVariance]


def cumulative(variances: list[float]) -> list[float]:
    return np.cumsum(variances).tolist()


def kmeans(xy: DataFrame, k: int, runs: int = 10, seed: int = 42) -> DataFrame:
    """xy with `cluster`, by the best of several runs."""
    rows = xy.withColumn("_v", array_to_vector("x")).cache()
    models = [KMeans(k=k, featuresCol="_v", predictionCol="cluster", seed=seed + r).fit(rows) for r in range(runs)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).drop("_v")


#: Rows of a tile in which distances are taken; most regions; rows, about, that their pivots are chosen among.
BLOCK, REGIONS, PIVOT_ROWS = 2000, 512, 4096
#: Parts that rows are dealt to, and about the most bytes of the vectors of one, of which there are more where these would pass.
PARTS, PART_BYTES = 12, 32 << 20
#: Rows of answers about tiles that a task puts together at once.
ANSWERS = 1 << 20


def spread_pivots(sample: np.ndarray, count: int, seed: int = 42) -> np.ndarray:
    """Rows of a sample that are spread over it: each next one is drawn by its squared distance to those before."""
    draw = np.random.default_rng(seed)
    sample = sample[np.lexsort(sample.T[::-1])] if sample.size else sample
    chosen = [int(draw.integers(len(sample)))]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(np.searchsorted(np.cumsum(nearest), draw.random() * nearest.sum()).clip(0, len(sample) - 1)))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _border(x: np.ndarray, home: np.ndarray, pivots: np.ndarray, apart: np.ndarray, reach: float, regions: np.ndarray) -> np.ndarray:
    """Which rows, whose nearest pivots are given, can be within reach of the planes between these and each of the regions' pivots."""
    of = pivots[regions]
    lengths = (of * of).sum(axis=1)
    squares = np.maximum((x * x).sum(axis=1)[:, None] + lengths - 2 * x @ of.T, 0)
    own = ((x - pivots[home]) ** 2).sum(axis=1)
    # a little more than rounding can take from the squares
    return squares - own[:, None] <= 2 * reach * apart[home[:, None], regions] + 1e-9 * (squares + lengths)


def _within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of x are within eps of which of y; what rounding of the squares leaves open is told by the differences."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    squares = np.column_stack([x, xx, np.ones(len(x))]) @ np.column_stack([-2 * y, np.ones(len(y)), yy]).T
    slack = 1e-9 * eps * eps + 1e-15 * (x.shape[1] + 8) * (xx.max(initial=0) + yy.max(initial=0))
    close = squares <= eps * eps + slack
    at = np.flatnonzero(close)
    at = at[squares.ravel()[at] >= eps * eps - slack]
    for start in range(0, len(at), BLOCK):
        i, j = np.divmod(at[start : start + BLOCK], len(y))
        close[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1)) <= eps
    return close


class Near:
    """Rows (run_id, x) in regions around pivots, and which regions' borders can hold rows within eps of each other.

    A row belongs to its nearest pivot's region. What is on the other side of the plane half-way between two pivots is at
    least as far from a row as that plane, so that of two regions only the rows within eps of the plane between them meet:
    their borders to each other. There are as many regions as there are times `block` rows, REGIONS at most.

    Regions, one after the other, are dealt to PARTS parts of equal size, more only where a part's vectors would pass
    PART_BYTES. Each pair of parts meets in one task, region by region in tiles of at most `block` rows a side, which returns
    what is asked about rows, never pairs. So a row is sent at most once for each part, and what is sent grows with the
    rows until there are some PARTS * PART_BYTES of vectors.
    """

    def __init__(self, xy: DataFrame, eps: float, stored, block: int = BLOCK, regions: int | None = None):
        self.eps, self.block, self.stored = eps, block, stored
        of = xy.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("width")).first()
        self.n, self.width = of["n"], of["width"]
        count = max(1, min(regions or -(-self.n // block), REGIONS))
        chosen = F.pmod(F.xxhash64("run_id"), F.lit(1 << 20)) < max(1, int(min(1.0, PIVOT_ROWS / max(1, self.n)) * (1 << 20)))
        sample = matrix(xy.where(chosen).select("x").toArrow()["x"].combine_chunks(), self.width)
        self.pivots = pivots = spread_pivots(sample, count) if len(sample) else np.zeros((1, self.width))
        self.apart = np.stack([np.sqrt(((pivots - p) ** 2).sum(axis=1)) for p in pivots])
        placed = stored(self._placed(xy))
        each = placed.select("home", F.explode(F.concat(F.array("home"), "borders")).alias("other"))
        self.sizes = stored(each.groupBy("home", "other").agg(F.count(F.lit(1)).alias("n")))  # no more rows than pairs of regions
        self.rows = stored(self._dealt(placed))

    def _placed(self, xy: DataFrame) -> DataFrame:
        """(run_id, x, home, borders): the nearest pivot, and those to whose regions the row is a border."""
        width, reach, pivots, apart = self.width, self.eps * (1 + 1e-9), self.pivots, self.apart
        schema = "run_id long, x array<double>, home int, borders array<int>"
        arrow = pa.schema([("run_id", pa.int64()), ("x", pa.list_(pa.float64())), ("home", pa.int32()), ("borders", pa.list_(pa.int32()))])

        def run(batches):
            for batch in batches:
                x = matrix(batch.column("x"), width)
                home = ((pivots * pivots).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1)
                border = _border(x, home, pivots, apart, reach, np.arange(len(pivots)))
                border[np.arange(len(x)), home] = False
                lists = [np.flatnonzero(row).astype(np.int32) for row in border]
                yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("x"), pa.array(home.astype(np.int32)), pa.array(lists, pa.list_(pa.int32()))], schema=arrow)

        return bounded_batches(xy.select(F.col("run_id").cast("long").alias("run_id"), F.col("x").cast("array<double>").alias("x")), width).mapInArrow(run, schema)

    def _dealt(self, placed: DataFrame) -> DataFrame:
        """(run_id, x, home, part, meets): the row's part, and the parts of its own and its bordering regions."""
        number = np.zeros(len(self.pivots), np.int64)
        for row in self.sizes.where("home = other").collect():  # a row for each region
            number[row["home"]] = row["n"]
        size = max(self.block, min(-(-self.n // PARTS), PART_BYTES // (8 * max(1, self.width))))
        starts = np.cumsum(number) - number
        of = lambda values, at: F.element_at(F.lit(values.tolist()), at + 1)
        position = of(starts, F.col("home")) + F.pmod(F.xxhash64("run_id"), of(np.maximum(number, 1), F.col("home")))
        first, last = starts // size, (starts + np.maximum(number, 1) - 1) // size
        meets = F.array_distinct(F.flatten(F.transform(F.concat(F.array("home"), "borders"), lambda at: F.sequence(of(first, at), of(last, at)))))
        return placed.select("run_id", "x", "home", F.floor(position / size).cast("long").alias("part"), meets.alias("meets"))

    def compared(self) -> tuple[int, int]:
        """How many pairs of rows meet in one pass, and how many there are, a row with itself among both."""
        a, b = self.sizes.alias("a"), self.sizes.alias("b")
        met = a.join(b, F.expr("a.home = b.other AND a.other = b.home AND a.home <= a.other"))
        pairs = met.agg(F.coalesce(F.sum(F.when(F.col("a.home") == F.col("a.other"), F.expr("a.n * (a.n + 1) div 2")).otherwise(F.expr("a.n * b.n"))), F.lit(0))).first()[0]
        return int(pairs), self.n * (self.n + 1) // 2

    def sent(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """The rows once for each pair of parts that they meet in: (low, high, part, home, x) and columns."""
        each = rows.withColumn("other", F.explode("meets"))
        return each.select(F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "home", "x", *columns)

    def meet(self, rows: DataFrame, columns: list[str], found, schema: str, combined=None) -> DataFrame:
        """found(left, right, close, same) of each two tiles as rows of schema; rows: self.rows, or some of them, with more
        columns.

        left and right are the columns as arrays, run_id among them; close says which rows are within eps, a row itself not;
        same that both are one tile. What is returned must hold for left and right rows alike unless they are the same.
        combined(*columns of schema), if given, puts the answers about many tiles together.
        """
        width, eps, block, pivots, apart = self.width, self.eps, self.block, self.pivots, self.apart
        names = [part.split()[0] for part in schema.split(", ")]
        kinds = [{"long": pa.int64(), "boolean": pa.bool_()}[part.split()[1]] for part in schema.split(", ")]

        def run(table: pa.Table) -> pa.Table:
            x = matrix(table.column("x").combine_chunks(), width)
            part, home = np.asarray(table.column("part")), np.asarray(table.column("home"))
            values = {name: np.asarray(table.column(name)) for name in columns}
            low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
            del table
            out = [[np.zeros(0, kind.to_pandas_dtype())] for kind in kinds]
            for a, b, same in _tiles(x, home, part == low, part == high, low == high, pivots, apart, eps * (1 + 1e-9), block):
                close = _within(x[a], x[b], eps)
                left, right = ({name: column[at] for name, column in values.items()} for at in (a, b))
                i, j = np.divmod(np.flatnonzero(close), len(b))
                itself = left["run_id"][i] == right["run_id"][j]
                close[i[itself], j[itself]] = False
                for column, answer in zip(out, found(left, right, close, same)):
                    column.append(answer)
                if combined and sum(map(len, out[0])) > ANSWERS:
                    out = [[column] for column in combined(*map(np.concatenate, out))]
            done = [np.concatenate(column) for column in out]
            return pa.table([pa.array(column, kind) for column, kind in zip(combined(*done) if combined else done, kinds)], names=names)

        return self.sent(rows, columns).groupBy("low", "high").applyInArrow(run, schema)


def _tiles(x, home, left, right, one: bool, pivots, apart, reach: float, block: int):
    """(a, b, same): the places of rows of both sides that meet, at most `block` each; one says that both sides are the same."""
    sides = [np.flatnonzero(side) for side in (left, right)]
    regions = [np.unique(home[side]) for side in sides]
    borders = [_border(x[side], home[side], pivots, apart, reach, other) for side, other in zip(sides, regions[::-1])]
    for at, h in enumerate(regions[0].tolist()):
        of_h = home[sides[0]] == h
        for to, k in enumerate(regions[1].tolist()):
            if one and k < h:
                continue
            of_k = home[sides[1]] == k
            a, b = (sides[0][of_h], sides[1][of_k]) if h == k else (sides[0][of_h & borders[0][:, to]], sides[1][of_k & borders[1][:, at]])
            same = one and h == k
            for start in range(0, len(a), block):
                for then in range(start if same else 0, len(b), block):
                    yield a[start : start + block], b[then : then + block], same and start == then


def _counted(left: dict, right: dict, close: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each row's close rows in the other tile."""
    if same:
        return left["run_id"], np.count_nonzero(close, axis=1)
    return np.concatenate([left["run_id"], right["run_id"]]), np.concatenate([np.count_nonzero(close, axis=1), np.count_nonzero(close, axis=0)])


def _summed(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(ids, return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, at, n)
    return known, total


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what edges (a, b) connect: each node and the least one that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    least, before = np.arange(len(nodes)), None
    while before is None or (least != before).any():
        before = least.copy()
        low = np.minimum(least[i], least[j])
        # also what the two were told to be part of, so that long chains take few rounds
        for ends in (before[i], before[j], i, j):
            np.minimum.at(least, ends, low)
        least = least[least]
    edge = least != np.arange(len(nodes))
    return nodes[edge], nodes[least[edge]]


def _linked(left: dict, right: dict, close: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.divmod(np.flatnonzero(close), close.shape[1])
    return _joined(left["run_id"][i], right["run_id"][j])


def _least_of(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(ids, return_inverse=True)
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, at, values)
    return known, least


def _bordering(left: dict, right: dict, close: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows that aren't core with the least root of a close core row; root is negative where a row isn't core."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for own, other, near in ((left, right, close), (right, left, close.T)):
        rows, cores = np.flatnonzero(~own["core"]), np.flatnonzero(other["core"])
        if len(rows) and len(cores):
            i, j = np.nonzero(near[np.ix_(rows, cores)])
            out.append(_least_of(own["run_id"][rows[i]], other["root"][cores[j]]))
    return tuple(np.concatenate(column) for column in zip(*out))


def components(nodes: DataFrame, edges: DataFrame, stored) -> DataFrame:
    """(node, root): the least node that edges (a, b), given both ways, reach; stored(df) cuts the lineage after each step."""
    labels = stored(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        least = labels.unionByName(near).groupBy("node").agg(F.min("root").alias("root"))
        jump = least.withColumnRenamed("root", "via").join(least.select(F.col("node").alias("via"), "root"), "via").select("node", "root")
        moved = stored(jump)
        changed = moved.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        labels = moved
        if not changed:
            return labels


def dbscan(xy: DataFrame, eps: float, least: int, stored, block: int = BLOCK) -> DataFrame:
    """(run_id, cluster): cluster is the least id of a cluster's core rows, or -1 for noise; a border row joins its least cluster.

    Ids are whole numbers. Three passes over the pairs of parts: rows within eps are counted, core rows linked, and
    border rows, where there are any that aren't core, given a cluster.
    """
    near = Near(xy.select(F.col("run_id").cast("long").alias("run_id"), "x"), eps, stored, block)
    counts = near.meet(near.rows, ["run_id"], _counted, "run_id long, n long", _summed).groupBy("run_id").agg((F.sum("n") + 1).alias("n"))
    core = stored(counts.where(F.col("n") >= least).select(F.col("run_id").alias("node")))
    cores = stored(near.rows.join(core, F.col("run_id") == F.col("node"), "left_semi"))
    links = stored(near.meet(cores, ["run_id"], _linked, "a long, b long", _joined).distinct())
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = components(core, both, stored)
    flagged = stored(near.rows.join(roots, F.col("run_id") == F.col("node"), "left").select("run_id", "x", "home", "part", "meets", F.col("root").isNotNull().alias("core"), F.coalesce("root", F.lit(-1)).cast("long").alias("root")))
    if flagged.where("NOT core").isEmpty():
        return flagged.select("run_id", F.col("root").alias("cluster"))
    border = near.meet(flagged, ["run_id", "core", "root"], _bordering, "run_id long, near long", _least_of).groupBy("run_id").agg(F.min("near").alias("near"))
    return flagged.join(border, "run_id", "left").select("run_id", F.when(F.col("core"), F.col("root")).otherwise(F.coalesce("near", F.lit(-1))).alias("cluster"))


SUMS = "run_id long, own long, cluster long, total double, n long"
_ARROW = pa.schema([("run_id", pa.int64()), ("own", pa.int64()), ("cluster", pa.int64()), ("total", pa.float64()), ("n", pa.int64())])


#: Rows and columns of a tile of distances, and about the most bytes of the vectors of one side of what meets in a task.
TILE_ROWS, TILE_COLUMNS, SIDE_BYTES = 500, 1000, 16 << 20


def distance_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x the sum of its distances to the rows of y, by tiles of 4 MB."""
    out = np.zeros(len(x))
    for then in range(0, len(y), TILE_COLUMNS):
        of = y[then : then + TILE_COLUMNS]
        lengths = (of * of).sum(axis=1)
        for start in range(0, len(x), TILE_ROWS):
            part = x[start : start + TILE_ROWS]
            squares = part @ (-2 * of.T)
            squares += (part * part).sum(axis=1)[:, None]
            squares += lengths
            np.maximum(squares, 0, out=squares)
            out[start : start + TILE_ROWS] += np.sqrt(squares, out=squares).sum(axis=1)
    return out


class Silhouette:
    """Sums of distances of rows (run_id, x, cluster) to their own cluster and to those that can be their nearest other one.

    The mean distance to a cluster is at least that to its mean, and at most the root of that distance's square plus the
    cluster's mean square about its mean. So a cluster whose least is more than another's most isn't compared. Rows that
    meet go in blocks of bounded size; a task returns sums of distances by row and cluster, not pairs.
    """

    def __init__(self, clustered: DataFrame, block: int = 20_000):
        from ..sources.storage import stored

        rows = clustered.select(F.col("run_id").cast("long").alias("run_id"), F.col("x").cast("array<double>").alias("x"), F.col("cluster").cast("long").alias("cluster"))
        sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).orderBy("cluster").collect()  # a row for each cluster
        self.names, self.n = [row["cluster"] for row in sizes], np.array([row["n"] for row in sizes], float)
        self.width = max((row["width"] or 0 for row in sizes), default=0)
        self.block = max(1, min(block, SIDE_BYTES // (8 * max(1, self.width))))
        self.rows = stored(self._with_candidates(rows, *self._moments(rows)))
        self.visits = dict(self.rows.select(F.explode("others").alias("k")).groupBy("k").count().collect())

    def _moments(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The mean of each cluster and the mean square about it."""
        number, width = {name: at for at, name in enumerate(self.names)}, self.width

        def by_cluster(value, columns: int) -> np.ndarray:
            def sums(batch: pa.RecordBatch) -> np.ndarray:
                at = np.array([number[name] for name in batch.column("cluster").to_pylist()], int)
                out = np.zeros((len(number), columns))
                np.add.at(out, at, value(matrix(batch.column("x"), width), at))
                return out

            return summed(rows.select("x", "cluster"), width, sums, (len(number), columns)) / np.maximum(self.n, 1)[:, None]

        means = by_cluster(lambda x, _: x, width)
        return means, by_cluster(lambda x, at: ((x - means[at]) ** 2).sum(axis=1)[:, None], 1)[:, 0]

    def _with_candidates(self, rows: DataFrame, means: np.ndarray, spreads: np.ndarray) -> DataFrame:
        """(run_id, x, k, others): the numbers of a row's cluster and of those that it is compared with."""
        number, width = {name: at for at, name in enumerate(self.names)}, self.width
        arrow = pa.schema([("run_id", pa.int64()), ("x", pa.list_(pa.float64())), ("k", pa.int32()), ("others", pa.list_(pa.int32()))])

        def run(batches):
            for batch in batches:
                x = matrix(batch.column("x"), width)
                own, at = np.array([number[name] for name in batch.column("cluster").to_pylist()], int), np.arange(batch.num_rows)
                squares = np.stack([((x - mean) ** 2).sum(axis=1) for mean in means], axis=1) if len(x) else np.zeros((0, len(means)))
                least, most = np.sqrt(squares) * (1 - 1e-9), np.sqrt(squares + spreads) * (1 + 1e-9)
                most[at, own] = np.inf
                compared = least <= most.min(axis=1, initial=np.inf)[:, None]
                compared[at, own] = True
                yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("x"), pa.array(own.astype(np.int32)), pa.array([np.flatnonzero(row).astype(np.int32) for row in compared], pa.list_(pa.int32()))], schema=arrow)

        return bounded_batches(rows, width).mapInArrow(run, "run_id long, x array<double>, k int, others array<int>")

    def compared(self) -> tuple[int, int]:
        """How many pairs of a row and another, or itself, are compared, and how many there are."""
        return int(sum(self.n[k] * visits for k, visits in self.visits.items())), int(self.n.sum() ** 2)

    def sums(self) -> DataFrame:
        """SUMS, of each row and each cluster that it is compared with."""
        names = np.array(self.names, np.int64)
        lefts = [max(1, -(-self.visits.get(k, 0) // self.block)) for k in range(len(names))]
        rights = [max(1, -(-int(n) // self.block)) for n in self.n]
        of = lambda counts, k: F.element_at(F.array(*map(F.lit, counts or [1])), F.col(k) + 1)
        every = lambda counts, k: F.explode(F.sequence(F.lit(0), of(counts, k) - 1))
        dealt = lambda counts, k, salt: F.pmod(F.xxhash64("run_id", F.lit(salt)), of(counts, k)).cast("int")
        left = self.rows.select("run_id", "x", F.col("k").alias("own"), F.explode("others").alias("k")).select("*", dealt(lefts, "k", 1).alias("p"), every(rights, "k").alias("q"))
        right = self.rows.select("run_id", "x", "k", dealt(rights, "k", 2).alias("q"), every(lefts, "k").alias("p"))
        width = self.width

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return _ARROW.empty_table()
            x, y = (matrix(t.column("x").combine_chunks(), width) for t in (a, b))
            totals = distance_sums(x, y)
            k = int(a.column("k")[0].as_py())
            return pa.table([a.column("run_id"), pa.array(names[np.asarray(a.column("own"))]), pa.array(np.full(len(x), names[k])), pa.array(totals), pa.array(np.full(len(x), len(y)))], schema=_ARROW)

        keys = ["k", "p", "q"]
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, SUMS)
        return met.groupBy("run_id", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouette(clustered: DataFrame, block: int = 20_000) -> DataFrame:
    """(silhouette): the mean over rows (run_id, x, cluster), Euclidean; null with one cluster or at most ten rows."""
    of = Silhouette(clustered, block)
    mine = F.col("cluster") == F.col("own")
    by_row = of.sums().groupBy("run_id").agg(F.max(F.when(mine, F.col("total"))).alias("t"), F.max(F.when(mine, F.col("n"))).alias("size"), F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"))
    a = F.col("t") / (F.col("size") - 1)
    s = F.when(F.col("size") > 1, (F.col("b") - a) / F.greatest(a, F.col("b"))).otherwise(0.0)
    return by_row.agg(F.when(F.lit(bool(of.n.sum() > 10)), F.avg(F.when(F.col("b").isNotNull(), s))).alias("silhouette"))


def cluster_report(clustered: DataFrame) -> DataFrame:
    return stats.vector_statistics(clustered, "cluster")
