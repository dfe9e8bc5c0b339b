"""Components and covariances of wide vectors: equal to dense linear algebra in small, and run at 131,072 dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import projection
from tessera.operators import prototypes as P

WIDE = 131_072


def dense_rows(spark, x, *more):
    names = [f"c{i} long" for i in range(len(more))]
    return spark.createDataFrame([(row.tolist(), *(int(m[i]) for m in more)) for i, row in enumerate(x)], ", ".join(["x array<double>", *names])).repartition(3)


@pytest.mark.parametrize("sparse", [False, True])
def test_components_equal_dense_ones(spark, sparse):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 40)) @ np.diag(0.8 ** np.arange(40)) + rng.normal(size=40)
    x[rng.random(x.shape) < 0.3] = 0
    rows = dense_rows(spark, x, np.arange(300)).toDF("x", "run_id")
    if sparse:
        rows = projection.by_coordinates(rows.select("run_id", F.posexplode("x").alias("feature_idx", "v")).where("v <> 0"))
    found = projection.components(rows, 5)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(found.variances, values[::-1][:5], rtol=0.01) and np.isclose(found.total, values.sum())
    assert np.allclose(found.components @ found.components.T, np.eye(5), atol=1e-8)
    assert np.abs((found.components[:2] * vectors.T[::-1][:2]).sum(axis=1)).min() > 0.99
    z = {r["run_id"]: r["z"] for r in found.transform(rows).collect()}
    assert np.allclose([z[i] for i in range(300)], (x - x.mean(axis=0)) @ found.components.T)
    assert np.allclose(found.explained, found.variances / found.total)


def test_components_at_the_edges(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0],), (None,)], "x array<double>")
    found = projection.components(rows, 5)
    assert found.components.shape == (2, 2) and np.allclose(found.variances, [2.0, 0.0]) and np.allclose(found.mean, [2, 1])
    assert [r["z"] is None for r in found.transform(rows).collect()] == [False, False, True]
    empty = projection.components(rows.where("false"), 3)
    assert empty.components.shape[0] == 0 and empty.total == 0


def test_components_of_sparse_rows_as_wide_as_an_encoder(spark):
    rng = np.random.default_rng(8)
    cells = [(run, int(i), float(v)) for run in range(60) for i, v in zip(rng.integers(0, WIDE, 50), rng.random(50) * 0.1)]
    cells += [(run, 7, 3.0 * (run % 2)) for run in range(60)] + [(run, WIDE - 1, 2.0 * (run % 3)) for run in range(60)]
    rows = projection.by_coordinates(spark.createDataFrame(cells, "run_id long, feature_idx long, v double"))
    found = projection.components(rows, 2, WIDE)
    assert found.components.shape == (2, WIDE) and {int(np.abs(c).argmax()) for c in found.components} == {7, WIDE - 1}
    assert np.allclose(sorted(found.variances), sorted([2.25, 4 * 2 / 3]), rtol=0.01)


@pytest.mark.parametrize("covariance", P.COVARIANCES)
@pytest.mark.parametrize("n", [30, 120])
def test_factored_covariances_equal_dense_ones(spark, monkeypatch, tmp_path, covariance, n):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n, 50)) * rng.random(50), np.arange(n) % 2
    x[y == 1] += 0.3
    rows = dense_rows(spark, x, y, np.arange(n)).toDF("x", "y", "run_id")
    model = P.Prototypes("mahalanobis", covariance, "ratio").fit(rows)
    monkeypatch.setattr(P, "COVARIANCE_DIMENSIONS", 10)
    wide = P.Prototypes("mahalanobis", covariance, "ratio").fit(rows)
    assert wide.precisions is None and wide.factored[0].directions.shape[0] <= n
    expected = {r["run_id"]: r["score"] for r in model.scores(rows).collect()}
    wide.save(spark, f"{tmp_path}/model")
    for own in (wide, P.Prototypes.load(spark, f"{tmp_path}/model")):
        assert all(abs(r["score"] - expected[r["run_id"]]) < 1e-6 for r in own.scores(rows).collect())


def test_covariance_of_some_rows(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(400, 4)) @ np.diag([1, 2, 3, 4]), np.arange(400) % 2
    rows = dense_rows(spark, x, y, np.arange(400)).toDF("x", "y", "run_id")
    for covariance in ("empirical", "per_class"):
        whole, some, every = (P.Prototypes("mahalanobis", covariance, covariance_rows=most).fit(rows) for most in (None, 60, 400))
        assert np.allclose(every.precisions, whole.precisions) and not np.allclose(some.precisions, whole.precisions, rtol=1e-3)
        assert np.allclose(some.precisions, whole.precisions, rtol=1, atol=0.3) and some.clone().covariance_rows == 60


def test_mahalanobis_as_wide_as_an_encoder(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(10, WIDE)), np.arange(10) % 2
    x[y == 1, :200] += 4
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(10)], "run_id long, x array<double>, y long")
    model = P.Prototypes("mahalanobis", "bayes_ridge", "ratio").fit(rows)
    assert model.factored[0].directions.shape == (9, WIDE)
    found = {r["run_id"]: r["score"] for r in model.scores(rows).select("run_id", "score").collect()}
    assert all((found[i] > 0.5) == (y[i] == 1) for i in range(10))
