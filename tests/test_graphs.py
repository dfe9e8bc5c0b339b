"""Attribution graphs against dense matrices."""

import numpy as np
import pytest

from tessera.operators import graphs as G
from tessera.sources import files, storage


@pytest.fixture(scope="module")
def made(spark):
    """Two runs of nodes in layers, the last of which are outputs, and one without edges; as matrices [target, source]."""
    rng = np.random.default_rng(12)
    matrices, probabilities = {}, {"a": [0.6, 0.3], "b": [0.5, 0.1], "c": [1.0]}
    edges = []
    for run, n in (("a", 12), ("b", 20)):
        m = np.triu(rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.4), 1).T
        m[-1, -2] = 0
        matrices[run] = m
        edges += [(run, int(s), int(t), float(m[t, s])) for t, s in np.argwhere(m)]
    edges += [("a", 0, 5, 1.0), ("a", 0, 5, -1.0)]
    logits = [(run, len(matrices.get(run, [0] * 4)) - len(p) + k, 100 + k, q) for run, p in probabilities.items() for k, q in enumerate(p)]
    features = [(run, node, node // 4, node % 3, node * 10, node / 2) for run, n in (("a", 8), ("b", 15)) for node in range(n)]
    return (
        matrices,
        probabilities,
        spark.createDataFrame(edges, "run_id string, source int, target int, weight double").repartition(3),
        spark.createDataFrame(logits, "run_id string, node int, token int, probability double"),
        spark.createDataFrame(features, "run_id string, node int, layer int, position int, feature_idx int, activation double"),
    )


def influence_of(m, p):
    sizes = np.abs(m).sum(axis=1, keepdims=True)
    a = np.abs(m) / np.where(sizes > 0, sizes, 1)
    front, out = np.concatenate([np.zeros(len(m) - len(p)), p]), np.zeros(len(m))
    for _ in range(len(m)):
        front = front @ a
        out += front
    return out


def test_influence_and_attribution(made):
    matrices, probabilities, edges, logits, _ = made
    found = {(r["run_id"], r["node"]): r["influence"] for r in G.node_influence(edges, logits, storage.stored).collect()}
    direct = {(r["run_id"], r["node"]): r["logit_attribution"] for r in G.logit_attribution(edges, logits).collect()}
    for run, m in matrices.items():
        p = probabilities[run]
        assert np.allclose([found.get((run, n), 0) for n in range(len(m))], influence_of(m, p))
        assert np.allclose([direct.get((run, n), 0) for n in range(len(m))], p @ m[-len(p) :])
    assert not [key for key in found if key[0] == "c"]


def test_compact_graphs(spark, made, tmp_path):
    matrices, probabilities, edges, logits, features = made
    influence = G.node_influence(edges, logits, storage.stored)
    rows = G.feature_rows(features, G.pruned(influence, 0.7), G.logit_attribution(edges, logits))
    runs = spark.createDataFrame([(run, [1, 2], 4, 42) for run in "abc"], "run_id string, input_tokens array<int>, n_layers int, seed int")
    files.write_graphs(G.compact(runs, logits, rows), f"{tmp_path}/graphs")
    back = files.read_graphs(spark, f"{tmp_path}/graphs")
    graphs = {r["run_id"]: r for r in back.collect()}
    assert graphs["c"]["features"] == [] and graphs["c"]["logit_tokens"] == [100] and graphs["a"]["logit_probabilities"] == [0.6, 0.3]
    for run, m in matrices.items():
        of = influence_of(m, probabilities[run])
        order = sorted((n for n in range(len(m)) if of[n] > 0), key=lambda n: (-of[n], n))
        before = np.cumsum([0, *of[order]])
        kept = [n for n, b in zip(order, before) if b < 0.7 * of.sum()]
        n_features = {"a": 8, "b": 15}[run]
        assert [f["feature_idx"] // 10 for f in graphs[run]["features"]] == [n for n in kept if n < n_features]
    one = G.top(back, 1).where("run_id = 'b'").first()["features"]
    assert one == graphs["b"]["features"][:1]
    assert all(f["position"] == 1 for r in G.at_position(back, 1).collect() for f in r["features"])


def test_no_edges_and_cycles(spark, made):
    *_, edges, logits, features = made
    assert G.node_influence(edges.limit(0), logits, storage.stored).count() == 0
    ring = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 1, 0, 1.0), ("a", 2, 0, 3.0), ("a", 0, 9, 2.0)], edges.schema)
    found = {r["node"]: r["influence"] for r in G.node_influence(ring, spark.createDataFrame([("a", 9, 1, 0.8)], logits.schema), storage.stored).collect()}
    assert abs(found[0] - 0.8 / 0.75) < 1e-9 and abs(found[2] - 0.8) < 1e-9
