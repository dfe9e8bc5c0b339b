"""Boosted trees against a brute force in NumPy that tries every cut of every feature."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting as B
from tessera.operators import classify as C


def brute(x, y, w, cuts, trees, depth, rate, l1=0.0, l2=1.0, least=1.0, gamma=0.0):
    """Margins, and (feature, cut, gain) of all cuts in the order of trees and levels."""
    shrunk = lambda g: np.sign(g) * max(abs(g) - l1, 0)
    score = lambda g, h: shrunk(g) ** 2 / (h + l2)
    margins, made = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margins))
        g, h = w * (p - y), w * p * (1 - p)
        step, level = np.zeros(len(y)), [np.arange(len(y))]
        step[:] = -rate * shrunk(g.sum()) / (h.sum() + l2)
        for _ in range(depth):
            deeper = []
            for rows in level:
                best = None
                for i, own in enumerate(cuts):
                    for cut in own:
                        left, right = rows[x[rows, i] < cut], rows[x[rows, i] >= cut]
                        if len(left) and len(right) and h[left].sum() >= least and h[right].sum() >= least:
                            gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[rows].sum(), h[rows].sum())
                            if best is None or round(gain, 9) > round(best[0], 9):
                                best = gain, i, cut, left, right
                if best and best[0] > max(1e-6, gamma):
                    made.append((best[1], best[2], best[0]))
                    for part in best[3:]:
                        step[part] = -rate * shrunk(g[part].sum()) / (h[part].sum() + l2)
                    deeper += best[3:]
            level = deeper
        margins += step
    return margins, made


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(160, 4)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int) ^ (rng.random(160) < 0.1)
    return x, y, np.where(rng.random(160) < 0.3, 2.0, 0.5)


@pytest.fixture(scope="module")
def xy(spark, data):
    x, y, w = data
    rows = [(i, x[i].tolist(), int(y[i]), float(w[i])) for i in range(160)] + [(900, None, 1, 1.0), (901, [1.0], None, 1.0)]
    return spark.createDataFrame(rows, "run_id long, x array<double>, y long, w double").repartition(3)


@pytest.mark.parametrize("settings", [{}, {"l1": 0.5, "l2": 3.0, "gamma": 0.4}, {"least_child_weight": 6.0, "positive_weight": 3.0}])
@pytest.mark.parametrize("dense", [True, False])
def test_equals_trying_every_cut(monkeypatch, xy, data, settings, dense):
    monkeypatch.setattr(B, "DENSE_CELLS", 1 << 22 if dense else 0)
    monkeypatch.setattr(B, "REFRESHED", 2)
    x, y, w = data
    cuts = [np.unique(x[:, i]) for i in range(4)]
    model = C.boosted(3, 3, 0.4, **settings).fit(xy, cuts, "w")
    rename = {"least_child_weight": "least"}
    margins, made = brute(x, y, w * np.where(y == 1, settings.get("positive_weight", 1), 1), cuts, 3, 3, 0.4, **{rename.get(k, k): v for k, v in settings.items() if k != "positive_weight"})
    found = [(tree.feature[n], tree.cut[n], tree.gain[n]) for tree in model.trees for n in np.flatnonzero(tree.feature >= 0)]
    assert [f[:2] for f in found] == [m[:2] for m in made] and np.allclose([f[2] for f in found], [m[2] for m in made])
    scores = {r["run_id"]: r["score"] for r in model.scores(xy).collect()}
    assert np.allclose([scores[i] for i in range(160)], 1 / (1 + np.exp(-margins))) and scores[900] is None and scores[901] is not None


def test_quantile_cuts(spark):
    rows = spark.createDataFrame([([float(i), float(i % 3), 5.0],) for i in range(100)], "x array<double>")
    first, second, third, none = B.quantile_cuts(rows, 4, 5)
    assert first.tolist() == [19, 39, 59, 79] and second.tolist() == [0, 1, 2] and third.tolist() == [5] and none.tolist() == []


def test_shares_of_rows_and_features(xy, data):
    rows = xy.where("x IS NOT NULL AND y IS NOT NULL")
    model = C.boosted(3, 2, 0.3, row_share=0.5, feature_share=0.5).fit(rows)
    for tree in model.trees:
        assert len({*tree.feature[tree.feature >= 0].tolist()}) <= 2
    again = C.boosted(3, 2, 0.3, row_share=0.5, feature_share=0.5).fit(rows.repartition(5))
    assert all((a.feature == b.feature).all() and np.allclose(a.value, b.value) for a, b in zip(model.trees, again.trees))
    drawn = B._drawn(np.arange(20_000).astype(np.int64), 0.3, 42, 1)
    assert 0.28 < drawn.mean() < 0.32 and 0.07 < (drawn & B._drawn(np.arange(20_000).astype(np.int64), 0.3, 42, 2)).mean() < 0.11


@pytest.mark.parametrize("normalize", ["none", "l2", "standard"])
def test_fits_and_is_saved(xy, data, tmp_path, normalize):
    rows = xy.where("x IS NOT NULL AND y IS NOT NULL")
    model = C.boosted(4, 3, 0.3, normalize=normalize).fit(rows)
    right = model.scores(rows).agg(F.avg(F.when((F.col("score") > 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0))).first()[0]
    assert right > 0.8 and {*model.top_features(2)} == {0, 1} and abs(model.weights().sum() - 1) < 1e-9
    model.save(f"{tmp_path}/model")
    again = C.boosted().load(f"{tmp_path}/model")
    assert again.settings == model.settings and again.scores(rows).orderBy("run_id").collect() == model.scores(rows).orderBy("run_id").collect()


def test_edges(spark):
    schema = "run_id long, x array<double>, y long"
    empty = C.boosted(2).fit(spark.createDataFrame([], schema))
    one = spark.createDataFrame([(n, [1.0, float(n)], 1) for n in range(20)], schema)
    assert [r["score"] for r in empty.scores(one.limit(2)).collect()] == [0.5, 0.5]
    model = C.boosted(2).fit(one)
    assert all(r["score"] > 0.6 for r in model.scores(one).collect()) and not model.weights().any()
