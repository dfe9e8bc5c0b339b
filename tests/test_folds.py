"""Linear models of all folds in one pass against fits one by one in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import classify as C
from tessera.operators import folds as D
from tessera.operators import passes


def newton(x, y, penalty):
    """Coefficients and intercept of the balanced, penalised logistic regression, to machine precision."""
    n, ones = len(y), y.sum()
    weight = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))
    a, w = np.hstack([x, np.ones((n, 1))]), np.zeros(x.shape[1] + 1)
    lam = np.diag([penalty] * x.shape[1] + [0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (weight * p * (1 - p) / n)[:, None]).T @ a + lam, a.T @ (weight * (p - y)) / n + lam @ w)
    return w


def prepared(x, train, normalize):
    if normalize == "l2":
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    if normalize == "standard":
        deviation = x[train].std(axis=0)
        return (x - x[train].mean(axis=0)) / np.where(deviation > 0, deviation, 1)
    return x


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 5)) * [1, 5, 0.2, 1, 0] + [0, 100, 0, 1, 3]
    y = (x[:, 0] + 0.1 * (x[:, 1] - 100) + rng.normal(size=300) > 0).astype(int)
    return x, y, np.array(["a", "b", "c", "d"])[rng.integers(0, 4, 300)]


@pytest.fixture(scope="module")
def xy(spark, data):
    x, y, g = data
    rows = [(i, x[i].tolist(), int(y[i]), str(g[i])) for i in range(300)] + [(900, None, 1, "a"), (901, x[0].tolist(), None, "b")]
    return spark.createDataFrame(rows, "run_id long, x array<double>, y long, dataset_id string").repartition(3)


@pytest.mark.parametrize("normalize", ["l2", "standard", "none"])
@pytest.mark.parametrize("sgd", [False, True])
def test_equals_fits_one_by_one(xy, data, normalize, sgd):
    x, y, g = data
    c = 20.0 if sgd else 2.0
    own = D.fit_folds(xy, "dataset_id", c, normalize, sgd, tolerance=1e-8)
    assert own.groups == ["a", "b", "c", "d"]
    scores = {r["run_id"]: r["score"] for r in own.scores(xy, "dataset_id").collect()}
    for model, held in enumerate([None, *own.groups]):
        train = g != held if held else np.ones(300, bool)
        z = prepared(x, train, normalize)
        w = newton(z[train], y[train], 1 / c if sgd else 1 / (c * train.sum()))
        assert np.allclose(own.coefficients[model], w[:-1], atol=2e-4 * max(1, np.abs(w[:-1]).max()))
        if held:
            expected = 1 / (1 + np.exp(-(z[~train] @ w[:-1] + w[-1])))
            assert np.allclose([scores[i] for i in np.flatnonzero(~train)], expected, atol=1e-3)
    assert scores[900] is None and scores[901] is not None


def test_passes_do_not_follow_the_folds(xy, monkeypatch):
    calls = []
    summed = passes.summed
    monkeypatch.setattr(D, "summed", lambda *args: calls.append(1) or summed(*args))
    for groups in (2, 12):
        calls.append(None)
        D.fit_folds(xy.where("x IS NOT NULL AND y IS NOT NULL").withColumn("k", F.col("run_id") % groups), "k")
    few, many = (calls[calls.index(None) + 1 :].index(None), len(calls) - 1 - max(i for i, v in enumerate(calls) if v is None))
    assert many <= few + 8 and many < 60


def test_folds_of_classifiers(xy):
    rows = xy.where("x IS NOT NULL AND y IS NOT NULL")
    model = C.linear(normalize="standard")
    held = {r["run_id"]: r["score"] for r in C.lodo_scores(model, rows).collect()}
    single = model.clone().fit(rows.where("dataset_id <> 'c'")).scores(rows.where("dataset_id = 'c'")).collect()
    assert len(held) == 300 and all(abs(held[r["run_id"]] - r["score"]) < 1e-4 for r in single)
    baseline, coefficients = C.lodo_coefficients(C.linear(), rows)
    library = C.linear().fit(rows.where("dataset_id <> 'a'")).weights()
    assert np.allclose([r["coef"] for r in coefficients.where("dataset_id = 'a'").orderBy("i").collect()], library, atol=1e-3 * np.abs(library).max())
    assert baseline.count() == 5 and C.out_of_fold(C.linear(), rows, 3).where("score IS NOT NULL").count() == 300


def test_saved_standard_model(xy, tmp_path):
    rows = xy.where("x IS NOT NULL AND y IS NOT NULL")
    model = C.linear(normalize="standard").fit(rows)
    model.save(f"{tmp_path}/model")
    again = model.load(f"{tmp_path}/model")
    assert again.scores(rows).orderBy("run_id").collect() == model.scores(rows).orderBy("run_id").collect()
    assert model.top_features(1, "abs") == [0]


def test_edges(spark):
    schema = "run_id long, x array<double>, y long, dataset_id string"
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1, "a"), (2, [1.0], 0, "a"), (3, [0.0, 1.0], 1, None), (4, [5.0, 1.0], 1, "b"), (5, [-1.0, None], 0, "b")], schema)
    own = D.fit_folds(rows, "dataset_id")
    assert own.groups == [None, "a", "b"] and own.scores(rows, "dataset_id").where("score IS NULL").count() == 0
    one = D.fit_folds(rows.where("y = 1"), "dataset_id")
    assert not one.coefficients.any() and one.scores(rows, "dataset_id").where("score = 0.5").count() == 5
    assert D.fit_folds(spark.createDataFrame([], schema), "dataset_id").groups == []
    with pytest.raises(ValueError):
        C.linear(normalize="max")
