"""The inverted multi-index against brute force: recall on the given vectors, exact rows where all cells are taken."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import multi_index, queries


def brute(rows, k):
    """(query_id, rank, vec_id, score) of the k nearest of every row with an id divisible by 50."""
    width = max(len(v) for _, v in rows)
    rows = [(i, [*map(float, v), *[0.0] * (width - len(v))]) for i, v in rows]

    def cosine(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))

    out = {}
    for i, v in rows:
        if i % 50 == 0:
            scored = sorted(((-round(cosine(v, w), 12), j) for j, w in rows if j != i))
            out[i] = [(rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return out


def ranked(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 12)))
    return out


@pytest.fixture()
def hostile(spark):
    some = np.random.default_rng(3).normal(size=(60, 6)).tolist()
    same, more = [1.0, 2.0, 0.0, -1.0, 0.5, 3.0], [(i, v) for i, v in enumerate(some, 1)]
    more += [(50, same), (100, same), (61, same), (62, same), (63, same), (63, same), (150, [1e300, 1.0]), (151, [1e300, 2.0]), (152, [3e-310]), (153, [0.0, 1.0, 0.0])]
    kept = [r for n, r in enumerate(more) if r not in more[:n] and r != (50, some[49])]
    out = [r for r in more if r != (50, some[49])] + [(200, None), (201, []), (202, [0.0, -0.0]), (203, [1.0, None]), (204, [float("nan"), 1.0]), (205, [float("inf")]), (None, same)]
    return kept, spark.createDataFrame([(i, v, "x", 1) for i, v in out], "vec_id long, embedding array<double>, first string, part int")


def test_all_cells_give_exact_rows(spark, hostile):
    kept, df = hostile
    v = multi_index.vectors(df)
    assert ranked(multi_index.nearest(v.where("id % 50 = 0"), v, 5, share=1.0).collect()) == brute(kept, 5)
    assert ranked(multi_index.nearest(v.where("id % 50 = 0"), v, 1000, share=0.1).collect()) == brute(kept, 1000), "k of all others are found at any share"


def test_parts_and_blocks_of_hot_groups(spark, hostile):
    kept, df = hostile
    v = multi_index.vectors(df)
    index = multi_index.Index(v)
    assert ranked(index.search(v.where("id % 50 = 0"), 5, 1.0, part_bytes=100).collect()) == brute(kept, 5)


def test_longer_queries(spark):
    v = multi_index.vectors(spark.createDataFrame([(1, [1.0]), (2, [-1.0])], "vec_id long, embedding array<float>"))
    q = multi_index.vectors(spark.createDataFrame([(0, [1.0, 0.0, 1.0])], "vec_id long, embedding array<float>"))
    assert ranked(multi_index.nearest(q, v, 5).collect()) == {0: [(1, 1, round(math.sqrt(0.5), 12)), (2, 2, -round(math.sqrt(0.5), 12))]}


def test_empty(spark):
    v = multi_index.vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert multi_index.nearest(v, v, 5).collect() == []


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(5)
    first, second, sizes = rng.random(9), rng.random(9), rng.integers(0, 4, (9, 9))
    cells = sorted((first[i] + second[j], i, j) for i in range(9) for j in range(9) if sizes[i, j])
    for least in (1, 20, 10_000):
        taken = multi_index.nearest_cells(first, second, sizes, least)
        assert taken == [(i, j) for _, i, j in cells][: len(taken)]
        held = [int(sizes[c]) for c in taken]
        assert sum(held) >= min(least, sizes.sum()) and sum(held[:-1]) < least


def test_recall_of_the_query(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = [*(rng.normal(size=(1500, 32)) + 2 * rng.normal(size=(8, 32))[rng.integers(0, 8, 1500)]).astype(np.float32)]
    vectors += [vectors[0]] * 700  # a cell with a third of all rows
    ids = list(range(len(vectors)))
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(vectors, pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    found = ranked(queries.op13_multi_index(spark, str(tmp_path)).collect())
    unit = np.array(vectors, float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[::50]:
        scores = unit @ unit[q]
        scores[q] = -9
        nearest = {*np.lexsort((ids, -np.round(scores, 12)))[:5].tolist()}
        assert all(abs(scores[i] - s) < 1e-9 for _, i, s in found[q]) and [r for r, *_ in found[q]] == [1, 2, 3, 4, 5]
        hits, total = hits + len(nearest & {i for _, i, _ in found[q]}), total + 5
    assert hits >= 0.9 * total
