"""Approximate nearest neighbours by cosine with an inverted multi-index.

Vectors are scaled to unit length and cut into two halves, each of which is quantised by a codebook of its own; a pair of
centroids is a cell, with the list of the entries coded so. The codebooks are fitted on at most about SAMPLE_ROWS vectors,
chosen by a hash; every vector is coded and indexed. A query takes pairs of centroids from a heap by summed distance, nearest
first, until the cells taken hold the given share of all entries (and k besides its own rows). All their entries are
reranked by the exact cosine. The share alone decides the recall and is the same at every size.

Entries are grouped by their first centroid, and a query goes, with the second centroids it takes there, to each such group
once. Groups are dealt out in parts and their queries in blocks of bounded bytes, so that a cell with any share of all rows
is no larger task than others; a part and a block meet as matrices, and k rows a query leave.

A vector that is null, zero, or holds a null or non-finite component takes no part; nor does a row without an id. Shorter
vectors count as padded with zeros. A candidate with a query's own id is not its neighbour; rows repeated with equal ids and
vectors count once. Ties go to the smaller id. Fewer candidates than k are all found; an empty table gives no rows. Columns
other than the named ones are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that the codebooks are fitted on, about; centroids of a half, if there are enough vectors; rounds of fitting.
SAMPLE_ROWS = 16_384
CENTROIDS, LEAST_PER_CENTROID, ROUNDS = 64, 4, 12
#: Share of all entries that a query's cells hold.
SHARE = 0.5
#: Bytes of a part of the entries and of a block of queries, with 8 for each component; rows compared at once.
PART_BYTES = 16 << 20
TILE = 1024
#: More than floating point can lose in a product of unit vectors.
SLACK = 1e-9

RESULT = "query_id long, vec_id long, score double"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, v): components as double; only vectors that take part, repeated rows once."""
    x = F.transform(vector_column, lambda c: c.cast("double"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = df.select(F.col(id_column).cast("long").alias("id"), x.alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).dropDuplicates(["id", "v"])


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as a matrix of that width, zeros on the right."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths, values = np.asarray(lists.value_lengths(), np.int64), np.asarray(lists.flatten(), np.float64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring the largest component to about 1: cosines stay, squares don't overflow."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, less what a row's own length adds to all."""
    return (centers * centers).sum(axis=1) - 2 * rows @ centers.T


def codebook(rows: np.ndarray, count: int) -> np.ndarray:
    """Centroids of rows by Lloyd's rounds from spread starting rows."""
    rows = rows[np.lexsort(rows.T[::-1])]  # the order they came in is of no account
    centers = rows[np.linspace(0, len(rows) - 1, count).astype(int)]
    for _ in range(ROUNDS):
        nearest = _distances(rows, centers).argmin(axis=1)
        sums, sizes = np.zeros_like(centers), np.bincount(nearest, minlength=count)
        np.add.at(sums, nearest, rows)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    return centers


def nearest_cells(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Non-empty cells by summed distance, nearest first, until they hold least entries: pairs (i, j) come off a heap, each
    of which lets in its next neighbours in the two orders of distance."""
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    d1, d2 = first[by_first].tolist(), second[by_second].tolist()
    sizes = sizes[by_first][:, by_second].tolist()
    heap, out, held = [(d1[0] + d2[0], 0, 0)], [], 0
    while heap and held < least:
        _, a, b = heapq.heappop(heap)
        if sizes[a][b]:
            out.append((int(by_first[a]), int(by_second[b])))
            held += sizes[a][b]
        if b + 1 < len(d2):
            heapq.heappush(heap, (d1[a] + d2[b + 1], a, b + 1))
        if b == 0 and a + 1 < len(d1):
            heapq.heappush(heap, (d1[a + 1] + d2[0], a + 1, 0))
    return out


class Index:
    """Codebooks, the coded entries (id, v, first, second) in shared scratch space, and the sizes of all cells."""

    def __init__(self, candidates: DataFrame, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS, width: int = 2):
        """width: components that vectors are padded to, at least."""
        of = candidates.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
        width = max(width, of["width"])
        self.rows, self.width = of["n"], width + width % 2
        chosen = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < F.lit(int(min(1.0, sample_rows / max(1, self.rows)) * (1 << 20)) or 1)
        sample = _matrix(candidates.where(chosen).select("v").toArrow().column("v"), self.width)
        count = max(1, min(centroids, len(sample) // LEAST_PER_CENTROID))
        sample = unit(sample) if len(sample) else np.zeros((1, self.width))
        self.codebooks = [codebook(half, count) for half in np.hsplit(sample, 2)]
        self.entries = common.stored(self._coded(candidates), "entries")
        self.sizes = np.zeros((count, count), np.int64)
        for first, second, n in self.entries.groupBy("first", "second").count().collect():  # no more rows than cells
            self.sizes[first, second] = n

    def _coded(self, candidates: DataFrame) -> DataFrame:
        width, codebooks = self.width, self.codebooks

        def kernel(part: pa.RecordBatch) -> dict:
            halves = np.hsplit(unit(_matrix(part.column("v"), width)), 2)
            first, second = (_distances(half, centers).argmin(axis=1).astype(np.int32) for half, centers in zip(halves, codebooks))
            return {"id": part.column("id"), "v": part.column("v"), "first": first, "second": second}

        return common.map_rows(candidates.select("id", "v"), "id long, v array<double>, first int, second int", kernel, 4096)

    def probes(self, queries: DataFrame, k: int, share: float) -> DataFrame:
        """(id, v, first, seconds): for each group that a query goes to the cells it takes there."""
        width, codebooks, sizes, least = self.width, self.codebooks, self.sizes, share * self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in common.slices(batches):
                halves = np.hsplit(unit(_matrix(part.column("v"), width)), 2)
                distances = [_distances(half, centers) for half, centers in zip(halves, codebooks)]
                rows, firsts, seconds = [], [], []
                for row, (d1, d2, own) in enumerate(zip(*distances, part.column("own").to_pylist())):
                    taken: dict[int, list[int]] = {}
                    for i, j in nearest_cells(d1, d2, sizes, max(least, k + own)):
                        taken.setdefault(i, []).append(j)
                    rows += [row] * len(taken)
                    firsts += taken
                    seconds += taken.values()
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("v").take(at), pa.array(firsts, pa.int32()), pa.array(seconds, pa.list_(pa.int32()))], schema=arrow)

        schema = "id long, v array<double>, first int, seconds array<int>"
        arrow = common.arrow_schema(queries.sparkSession, schema)
        repeated = self.entries.groupBy("id").agg(F.count(F.lit(1)).alias("own")).where("own > 1")
        own = queries.select("id", "v").join(repeated, "id", "left").select("id", "v", F.coalesce("own", F.lit(1)).alias("own"))
        return common.small_batches(own).mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int, share: float = SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
        """(query_id, rank, vec_id, score) of the nearest entries found for each of queries (id, v)."""
        probes = common.stored(self.probes(queries, k, share), "probes")
        rows = max(1, part_bytes // (8 * max(1, self.width)))
        visits = dict(probes.groupBy("first").count().collect())  # no more rows than centroids
        parts = [max(1, -(-int(n) // rows)) for n in self.sizes.sum(axis=1)]
        blocks = [max(1, -(-visits.get(first, 0) // rows)) for first in range(len(parts))]
        width, of = self.width, lambda counts: F.element_at(F.array(*map(F.lit, counts)), F.col("first") + 1)
        dealt = lambda counts: F.pmod(F.xxhash64("id", "v"), of(counts)).cast("int")
        copies = lambda counts: F.explode(F.sequence(F.lit(0), of(counts) - 1))
        left = probes.select("id", "v", "first", "seconds", dealt(blocks).alias("block"), copies(parts).alias("part"))
        right = self.entries.select("id", "v", "first", "second", dealt(parts).alias("part"), copies(blocks).alias("block"))

        def meet(q: pa.Table, x: pa.Table) -> pa.Table:
            if not q.num_rows or not x.num_rows:
                return _ARROW.empty_table()
            taken = np.zeros((q.num_rows, int(np.asarray(x.column("second")).max()) + 1), bool)
            lists = q.column("seconds").combine_chunks()
            row, second = np.repeat(np.arange(q.num_rows), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())
            inside = second < taken.shape[1]
            taken[row[inside], second[inside]] = True
            own, other = (_matrix(t.column("v"), width) for t in (q, x))
            found = best_of(np.asarray(q.column("id")), own, taken, np.asarray(x.column("id")), other, np.asarray(x.column("second")), k)
            return pa.table(list(map(pa.array, found)), schema=_ARROW)

        keys = ["first", "block", "part"]
        best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, RESULT)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with that of b; equal rows give equal values wherever they stand."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best_of(query_ids: np.ndarray, queries: np.ndarray, taken: np.ndarray, ids: np.ndarray, rows: np.ndarray, cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query among the cells it takes: query ids, ids and exact scores."""
    out = []
    units, unit_rows = unit(queries), unit(rows)
    for first in range(0, len(queries), TILE):
        at = slice(first, first + TILE)
        q, x, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(len(queries[at]), -np.inf)
        scores = np.zeros(0)
        for other in range(0, len(rows), TILE):
            to = slice(other, other + TILE)
            near = units[at] @ unit_rows[to].T
            near[~taken[at][:, cells[to]] | (query_ids[at][:, None] == ids[to])] = -np.inf
            if k < near.shape[1]:  # entries worse than k others of this tile, or than the k-th so far, are out
                least_here = np.partition(near, -k, axis=1)[:, -k]
                near[near < (np.maximum(least, least_here) - SLACK)[:, None]] = -np.inf
            new_q, new_x = np.nonzero(near > -np.inf)
            exact = cosines(queries[first + new_q], rows[other + new_x])
            q, x, scores = np.concatenate([q, new_q]), np.concatenate([x, other + new_x]), np.concatenate([scores, exact])
            order = np.lexsort((ids[x], -scores, q))
            rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
            order = order[rank < k]
            q, x, scores = q[order], x[order], scores[order]
            full = np.flatnonzero(rank[rank < k] == k - 1)
            least[q[full]] = scores[full]
        out.append((query_ids[first + q], ids[x], scores))
    return tuple(np.concatenate(column) for column in zip(*out))


def nearest(queries: DataFrame, candidates: DataFrame, k: int, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors() of both."""
    longest = queries.agg(F.coalesce(F.max(F.size("v")), F.lit(2))).first()[0]
    return Index(candidates, width=longest).search(queries, k, share)
