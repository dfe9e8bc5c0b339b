"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are padded with zeros to equal lengths and cut into segments at several resolutions. With the mean and the
deviation (the norm of what the mean leaves) of each segment, |q - x|^2 is at least the sum over segments of
n (mean_q - mean_x)^2 + (dev_q - dev_x)^2, so the inner product (|q|^2 + |x|^2 - |q - x|^2) / 2 is at most
the sum of n mean_q mean_x + dev_q dev_x. Coarse to fine, candidates whose bound is below a query's k-th best exact
score so far are dropped; survivors get exact integer scores.

Queries are dealt to blocks by a hash, candidates to parts; each block meets each part in one task, both of at most
BLOCK_BYTES as matrices, and returns at most k rows for each query. No pair of rows is ever emitted otherwise. A candidate
is copied once for each block: for 64 components a copy takes as long as comparing it with a few hundred queries, and a
block has tens of thousands.

A vector that is null, or holds a null or non-finite component, takes no part; nor does a row without an id. Shorter
vectors count as padded with zeros. A candidate with a query's own id is not its neighbour; rows repeated with
equal ids and vectors count once. Ties go to the smaller id. Fewer candidates than k give fewer rows, an empty table gives
none. Columns other than the named ones are ignored. Components are integers of any size, as doubles or longs. Where scores
might not fit into 62 bits, they are summed in whole numbers of any length; one among a query's k best that doesn't fit into
a long is an error that names it when the rows are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Segments of a vector at each resolution, coarse to fine.
RESOLUTIONS = (1, 4, 16)
#: Bytes of a block of queries, and of a part of the candidates, with 8 for each component.
BLOCK_BYTES = 32 << 20
#: Candidates that a part has at least, if there are enough tasks without it.
LEAST_PART_ROWS = 2048
#: Candidates and queries that are compared at once.
TILE, QUERY_TILE = 1024, 1024
#: Pairs whose vectors are gathered at once.
PAIRS = 16384

RESULT = "query_id long, vec_id long, score long, side int"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("side", pa.int32())])


def integer_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, v): components as floor(scale * x), x as double; only vectors that take part."""
    x = F.col(vector_column)

    def floored(c):
        times = F.lit(scale) * c.cast("double")  # from 2^53 on all doubles are whole
        return F.when(F.abs(times) < float(1 << 53), F.floor(times).cast("double")).otherwise(times)

    whole = F.transform(x, floored)
    finite = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(finite & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as a matrix of that width, zeros on the right."""
    lists = column.combine_chunks()
    lengths, values = np.asarray(lists.value_lengths(), np.int64), np.asarray(lists.flatten())
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _is_wide(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows whose products with others like them might not fit into 62 bits."""
    return (np.abs(rows.astype(np.float64)) >= (2.0**62 / width) ** 0.5).any(axis=1)


def wide_pairs(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, int | None, int]]:
    """(query id, id, score, side) of the k best candidates of each query, in whole numbers of any length; a score that
    doesn't fit into a long is null, with side 1 or -1 for too large or too small."""
    whole = lambda row: [int(c) for c in row]
    columns = np.array([whole(row) for row in vectors], object).reshape(vectors.shape)
    for query_id, query in zip(query_ids.tolist(), queries):
        products = (columns * np.array(whole(query), object)).sum(axis=1).tolist() if len(columns) else []
        best = heapq.nsmallest(k, ((-score, i) for score, i in zip(products, ids.tolist()) if i != query_id))
        for score, i in best:
            fits = -(1 << 63) <= -score < 1 << 63
            yield query_id, i, -score if fits else None, 0 if fits else 1 if score < 0 else -1


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pa.Table:
    """RESULT with the k best candidates of each query: those of pairs with a wide row, and those of all others by bounds."""
    width = max(1, queries.shape[1])
    wide_q, wide_x = _is_wide(queries, width), _is_wide(vectors, width)
    narrow = search_block(query_ids[~wide_q], queries[~wide_q].astype(np.int64), ids[~wide_x], vectors[~wide_x].astype(np.int64), k)
    wide = [*wide_pairs(query_ids[wide_q], queries[wide_q], ids, vectors, k), *wide_pairs(query_ids[~wide_q], queries[~wide_q], ids[wide_x], vectors[wide_x], k)]
    columns = zip(*wide) if wide else ([], [], [], [])
    parts = [pa.table([*map(pa.array, narrow), pa.array(np.zeros(len(narrow[0]), np.int32))], schema=_ARROW), pa.table([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)]
    return pa.concat_tables(parts)


class Statistics:
    """For each resolution the vectors' means (times the root of the segment length) and deviations, side by side."""

    def __init__(self, vectors: np.ndarray):
        self.levels = []
        for count in RESOLUTIONS:
            parts = vectors.reshape(len(vectors), count, -1).astype(np.float64)
            means = parts.mean(axis=2)
            deviations = np.sqrt(((parts - means[:, :, None]) ** 2).sum(axis=2))
            self.levels.append(np.hstack([means * np.sqrt(parts.shape[2]), deviations]))

    def rows(self, which) -> list[np.ndarray]:
        return [level[which] for level in self.levels]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, all exact: arrays of query ids, ids and scores."""
    width = -(-max(queries.shape[1], 1) // RESOLUTIONS[-1]) * RESOLUTIONS[-1]
    queries, vectors = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, vectors))
    out = []
    of_vectors = Statistics(vectors)
    longest = np.linalg.norm(vectors.astype(np.float64), axis=1).max(initial=0)
    for first in range(0, len(queries), QUERY_TILE):
        own_ids, own = query_ids[first : first + QUERY_TILE], queries[first : first + QUERY_TILE]
        of_queries = Statistics(own)
        reach = np.linalg.norm(own.astype(np.float64), axis=1) * longest
        slack = 1e-3 + 1e-12 * reach  # more than floating point can lose in a bound
        whole = reach.max(initial=0) < 2**52  # then sums of products are exact in floating point
        best_ids = np.full((len(own), k), np.iinfo(np.int64).max)
        best = np.full((len(own), k), np.iinfo(np.int64).min)
        for rows in _tiles(len(vectors)):
            q, x = _survivors(of_queries.levels, of_vectors.rows(rows), best[:, -1] - slack)
            exact = _scores(own, vectors[rows], q, x, whole)
            keep = (own_ids[q] != ids[rows][x]) & (exact >= best[q, -1])
            if keep.any():
                _merge(best, best_ids, q[keep], ids[rows][x[keep]], exact[keep])
        found = best_ids != np.iinfo(np.int64).max
        out.append((np.repeat(own_ids, k).reshape(-1, k)[found], best_ids[found], best[found]))
    return tuple(np.concatenate(column) for column in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _scores(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, x: np.ndarray, whole: bool) -> np.ndarray:
    """Exact inner products of the pairs (q, x), by one product of matrices where these are many."""
    if len(q) * 16 >= len(queries) * len(vectors):
        kind = np.float64 if whole else np.int64
        return (queries.astype(kind) @ vectors.T.astype(kind))[q, x].astype(np.int64)
    parts = [np.einsum("ij,ij->i", queries[q[at : at + PAIRS]], vectors[x[at : at + PAIRS]]) for at in range(0, len(q), PAIRS)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _tiles(total: int, least: int = 64):
    """Slices that grow up to TILE: the first ones set the scores that the bounds of the others must reach."""
    at, size = 0, least
    while at < total:
        yield slice(at, at + size)
        at, size = at + size, min(TILE, size * 2)


def _survivors(queries: list[np.ndarray], vectors: list[np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) positions whose bound reaches the query's least score at every resolution.

    Rows and columns without a survivor are dropped before the next, finer resolution.
    """
    q, x = np.arange(len(least)), np.arange(len(vectors[0]))
    alive = np.ones((len(q), len(x)), bool)
    for own, other in zip(queries, vectors):
        alive &= own[q] @ other[x].T >= least[q][:, None]
        some_q, some_x = alive.any(axis=1), alive.any(axis=0)
        q, x, alive = q[some_q], x[some_x], alive[some_q][:, some_x]
        if not len(q):
            break
    at_q, at_x = np.nonzero(alive)
    return q[at_q], x[at_x]


def _merge(best: np.ndarray, best_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
    """Puts new candidates into the tables of the best, by score and then id."""
    k = best.shape[1]
    touched, back = np.unique(q, return_inverse=True)
    all_q = np.concatenate([back, np.repeat(np.arange(len(touched)), k)])
    all_ids = np.concatenate([ids, best_ids[touched].ravel()])
    all_scores = np.concatenate([scores, best[touched].ravel()])
    order = np.lexsort((all_ids, -all_scores.astype(np.float64), all_q)) if np.abs(all_scores[all_scores > np.iinfo(np.int64).min], dtype=np.float64).max(initial=0) < 2**52 else np.array(sorted(range(len(all_q)), key=lambda i: (all_q[i], -int(all_scores[i]), all_ids[i])), dtype=np.int64)
    starts = np.searchsorted(all_q[order], np.arange(len(touched)))
    take = order[starts[:, None] + np.arange(k)]
    best[touched], best_ids[touched] = all_scores[take], all_ids[take]


def top_k(queries: DataFrame, candidates: DataFrame, k: int, block_bytes: int = BLOCK_BYTES, part_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) for integer vectors (id, v); exact.

    The numbers of blocks and parts follow from the rows and the longest vector, so that a task's memory is bounded at
    any size.
    """
    queries, candidates = queries.dropDuplicates(["id", "v"]), candidates.dropDuplicates(["id", "v"])
    of = [df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first() for df in (queries, candidates)]
    width = max(1, *(each["width"] for each in of))
    blocks = max(1, -(-of[0]["n"] * width * 8 // block_bytes))
    parallel = queries.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-of[1]["n"] * width * 8 // part_bytes), min(4 * parallel, of[1]["n"] // LEAST_PART_ROWS) // blocks)
    by_block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    by_part = F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")
    left = queries.select("id", "v", by_block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = candidates.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), by_part.alias("part"))

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return _ARROW.empty_table()
        return search(np.asarray(q.column("id")), _matrix(q.column("v"), width), np.asarray(x.column("id")), _matrix(x.column("v"), width), k)

    best = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, RESULT)
    # the few best of each part and query are ranked; only k of a query leave each task
    order = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.asc("vec_id"))
    too_long = F.raise_error(F.concat(F.lit("the score of "), F.col("query_id"), F.lit(" and "), F.col("vec_id"), F.lit(" doesn't fit into a long"))).cast("long")
    score = F.when(F.col("side") == 0, F.col("score")).otherwise(too_long).alias("score")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
