"""Regions around pivots: rows within eps meet, whatever the regions, and far ones needn't."""

import tracemalloc

import numpy as np
import pytest

from tessera.operators import unsupervised as U
from tessera.sources import storage


@pytest.mark.parametrize("regions, block, eps", [(1, 1000, 0.5), (7, 20, 0.5), (25, 1000, 0.1), (25, 10, 3.0)])
def test_all_close_pairs_meet(spark, regions, block, eps):
    def _pairs(left, right, close, same):
        at = np.argwhere(close)
        return left["run_id"][at[:, 0]], right["run_id"][at[:, 1]]

    rng = np.random.default_rng(regions)
    x = np.vstack([rng.normal(size=(60, 3)), rng.normal(size=(60, 3)) * 0.1 + 5, np.repeat([[9.0, 9.0, 9.0]], 30, axis=0), [[0, 0, 0], [eps, 0, 0]]])
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "run_id long, x array<double>").repartition(3)
    near = U.Near(rows, eps, storage.stored, block, regions)
    found = {tuple(sorted(r)) for r in near.meet(near.rows, ["run_id"], _pairs, "a long, b long").collect()}
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert found == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if apart[i, j] <= eps}
    met, all_ = near.compared()
    assert all_ == 152 * 153 // 2 and met <= all_ and (met < all_ / 2 if eps == 0.1 else True) and (met == all_ if regions == 1 else True)


def test_rows_are_sent_once_for_each_part(spark):
    """What is sent grows with the rows, not with their square, also where every region borders every other."""
    rng = np.random.default_rng(3)
    for n in (400, 1600):
        rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rng.normal(size=(n, 20)))], "run_id long, x array<double>")
        near = U.Near(rows, 6.0, storage.stored, block=10)
        assert near.sent(near.rows, ["run_id"]).count() <= n * (U.PARTS + 1)
    assert near.sizes.where("home <> other").count() > 1000


def test_joined_edges_reach_the_least():
    rng = np.random.default_rng(4)
    chain = rng.permutation(500) * 3
    a, b = U._joined(np.concatenate([chain[:-1], [7000]]), np.concatenate([chain[1:], [9000]]))
    assert dict(zip(a.tolist(), b.tolist())) == {**{i * 3: 0 for i in range(1, 500)}, 9000: 7000}


@pytest.mark.parametrize("eps, far", [(1.0, 0.0), (1.0, 1e6), (0.0, 5.0)])
def test_within_by_differences(eps, far):
    x = np.array([[far, 0, 0], [far + 1, 0, 0], [far + 1, 1e-9, 0], [far, 3, 4]])
    assert (U._within(x, x, eps) == (np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps)).all()


def test_no_rows(spark):
    near = U.Near(spark.createDataFrame([], "run_id long, x array<double>"), 1.0, storage.stored)
    assert near.rows.count() == 0 and near.compared() == (0, 0)


def test_pivots_are_spread():
    sample = np.repeat(np.eye(4) * 10, 50, axis=0)
    pivots = U.spread_pivots(sample, 9)
    assert len(pivots) == 4 and {int(p.argmax()) for p in pivots} == {0, 1, 2, 3}


@pytest.mark.parametrize("block", [15, 1000])
def test_silhouette_compares_only_what_can_be_nearest(spark, block):
    rng = np.random.default_rng(5)
    centers = np.array([[0, 0], [3, 0], [20, 0], [23, 1], [60, 60]])
    own = np.concatenate([np.repeat(np.arange(5), [30, 20, 10, 25, 1])])
    x = centers[own] + rng.normal(size=(len(own), 2))
    rows = spark.createDataFrame([(i, row.tolist(), int(k) * 10) for i, (row, k) in enumerate(zip(x, own))], "run_id long, x array<double>, cluster long").repartition(3)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    values = []
    for i, k in enumerate(own):
        size = (own == k).sum()
        a, b = apart[i, own == k].sum() / max(size - 1, 1), min(apart[i, own == c].mean() for c in range(5) if c != k)
        values.append((b - a) / max(a, b) if size > 1 else 0)
    assert abs(U.silhouette(rows, block).first()[0] - np.mean(values)) < 1e-9
    met, all_ = U.Silhouette(rows, block).compared()
    assert all_ == 86**2 and met < all_ * 0.6


def test_distance_sums_take_bounded_memory(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(1200, 8)), rng.normal(size=(20_000, 8))
    tracemalloc.start()
    found = U.distance_sums(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    assert np.allclose(found[::100], [np.sqrt(((y - row) ** 2).sum(axis=1)).sum() for row in x[::100]])
    assert U.distance_sums(x[:0], y).shape == (0,) and (U.distance_sums(x, y[:0]) == 0).all()
    wide = spark.createDataFrame([(i, [float(i)] * 4096, i % 2) for i in range(4)], "run_id long, x array<double>, cluster long")
    assert U.Silhouette(wide).block * 4096 * 8 <= U.SIDE_BYTES


def test_silhouette_of_no_rows(spark):
    assert U.silhouette(spark.createDataFrame([], "run_id long, x array<double>, cluster int")).first()[0] is None
