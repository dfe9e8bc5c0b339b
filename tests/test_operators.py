"""Small tables for behaviour that the queries over whole tables don't reach."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import classify as C
from tessera.operators import layout as L
from tessera.operators.adversarial import Adversarial, Network
from tessera.operators.checkpoints import top_indices
from tessera.operators.prototypes import COVARIANCES, Prototypes
from tessera.operators import matrix as M
from tessera.operators import metrics
from tessera.operators import registry as R
from tessera.operators import stats
from tessera.operators import unsupervised as U
from tessera.plans import catalog
from tessera.plans import ingest as I
from tessera.sources import converters as K
from tessera.sources import storage
from tessera.streaming import ingest as streaming


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def test_guard_output(spark):
    rows = column(spark, ["safe", "unsafe\nS1,S10,S2", "Unsafe", "", "maybe", "unsafe S14"]).select(X.guard_verdict(F.col("c")), X.guard_categories(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("SAFE", []), ("UNSAFE", ["S1", "S10", "S2"]), ("UNSAFE", []), (None, []), (None, []), ("UNSAFE", [])]


def test_judge_output(spark):
    assert [r[0] for r in column(spark, ["SAFE.", "This is unsafe", "n/a", None]).select(X.judge_verdict(F.col("c"))).collect()] == ["SAFE", "UNSAFE", None, None]


def test_tools_are_stripped(spark):
    text = "a<TOOLS>x\ny</tools>b<tool_call>z</tool_call>"
    assert column(spark, [text]).select(X.without_tools(F.col("c"))).first()[0] == "ab<tool_call>z</tool_call>"


@pytest.mark.parametrize("specs, n, expected", [(["first", "last"], 45, [0, 44]), (["0", "10", "last"], 20, [0, 10, 19]), (["-1", "last"], 5, [4]), (["all"], 3, [0, 1, 2])])
def test_positions(spark, specs, n, expected):
    df = spark.createDataFrame([(specs, n)], "s array<string>, n int")
    assert df.select(M.resolve_positions(F.col("s"), F.col("n"))).first()[0] == expected


def test_position_outside(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(["-5"], 4)], "s array<string>, n int").select(M.resolve_positions(F.col("s"), F.col("n"))).collect()


def test_layers():
    assert M.resolve_layers(["all"], 3) == [0, 1, 2] and M.resolve_layers([2, 0, 2], 3) == [0, 2]
    with pytest.raises(ValueError):
        M.resolve_layers([-1], 3)


def test_label_filters(spark):
    df = column(spark, ['{"k": 1}', '{"k": 10}', '{"K": 1}', '{"a": {"k": 1}}'])
    assert df.where(R.label_like(F.col("c"), "k", "1")).count() == 4
    assert df.where(R.label_filter(F.col("c"), "k", "1")).count() == 1


def runs_table(spark):
    rows = [(f"test_run_{i:03}", f"test:{i}", "A" if i < 3 else "B", "completed" if i % 2 == 0 else "failed", f'{{"success": {str(i % 2 == 0).lower()}, "id": {i}}}', f"key_{i}", f"2025-01-0{i + 1}") for i in range(5)]
    return spark.createDataFrame(rows, "run_id string, prompt_id string, dataset_id string, status string, prompt_labels string, run_key string, timestamp string")


def test_get_runs(spark):
    runs = runs_table(spark)
    counts = [R.get_runs(runs, **a).count() for a in ({"dataset_id": "A"}, {"dataset_id": "B"}, {"status": "completed"}, {"status": "failed"}, {"labels": {"success": "true"}}, {"dataset_id": "A", "status": "completed"}, {"limit": 2}, {"dataset_id": "", "limit": 0})]
    assert counts == [3, 2, 3, 2, 3, 2, 2, 5]


def test_current_keeps_labels(spark):
    events = spark.createDataFrame([("r", 1, "pending", None), ("r", 2, "running", '{"a": 1}'), ("r", 3, "completed", None)], "run_id string, event_no long, status string, labels string")
    assert R.current(events).first()[1:] == ("completed", '{"a": 1}')


def test_status_is_checked(spark):
    with pytest.raises(PySparkException):
        column(spark, ["lost"]).select(R.checked_status(F.col("c"))).collect()


def test_negative_features(spark):
    kind = "array<struct<layer:int,position:int,feature_idx:int>>"
    with pytest.raises(PySparkException):
        column(spark, [[(0, 0, -1)]], kind).select(M.checked_features(F.col("c"))).collect()


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, y long")


def test_auc(spark):
    perfect = scored(spark, [(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)])
    assert metrics.roc_auc(perfect).first()[0] == 1.0 and metrics.pr_auc(perfect).first()[0] == 1.0
    ties = scored(spark, [(0.5, 1), (0.5, 0), (0.7, 1), (0.1, 0)])
    assert metrics.roc_auc(ties).first()[0] == 0.875
    assert metrics.roc_auc(ties.withColumn("score", -F.col("score"))).first()[0] == 0.125
    assert metrics.roc_auc(scored(spark, [(0.5, 1), (0.6, 1)])).first()[0] is None


def test_weighted_average_skips_null(spark):
    df = spark.createDataFrame([("a", 0.5, 10), ("b", None, 90)], "d string, m double, n long")
    assert metrics.weighted_average(df, "n", "m").first()[0] == 0.5


def test_position_filter_drops_runs(spark):
    acts = spark.createDataFrame([(1, 0, 0, 1.0), (1, 2, 1, 2.0), (2, 1, 0, -1.0)], "run_id long, position long, feature_idx long, v double")
    assert sorted(r["run_id"] for r in M.at_position(acts, -2).collect()) == []
    assert sorted((r["run_id"], r["position"]) for r in M.at_position(acts, "last").collect()) == [(1, 2), (2, 1)]
    assert [(r["row"], r["v"]) for r in M.activation_matrix(acts, "first", 16).collect()] == [(0, 1.0)]


def test_shards_partition(spark):
    df = spark.range(23).withColumnRenamed("id", "idx")
    parts = [K.shard(df, k, 4) for k in range(4)]
    assert [p.count() for p in parts] == [K.shard_size(23, k, 4) for k in range(4)] and K.union_all(parts).distinct().count() == 23
    with pytest.raises(ValueError):
        K.shard(df, 4, 4)


def test_converters_exclude_filters():
    for make in (K.deepset, K.safeguard, K.qualifire, K.wildjailbreak):
        with pytest.raises(ValueError):
            make(malicious_only=True, benign_only=True)
    with pytest.raises(ValueError):
        K.mosscap(level=9)


def test_converter_nulls(spark):
    df = spark.createDataFrame([(0, None, None), (1, "x", 1)], "idx long, text string, label int")
    assert [m["messages"][0]["content"] for m in K.deepset().convert(df).orderBy("prompt_id").collect()] == ["", "x"]
    assert K.name_of_source("org/some-data", "sub") == "some_data_sub"


def xy(spark, n=200, d=4, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(0, 1, (n, d)) + y[:, None] * 2
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i]), int(i % 3)) for i in range(n)], "run_id long, x array<double>, y long, dataset_id long"), x, y


def accuracy(df, threshold=0.5):
    return metrics.confusion(metrics.predicted(df, threshold)).first()["accuracy"]


@pytest.mark.parametrize("make", [C.linear, lambda: Prototypes("euclidean"), lambda: Prototypes("mahalanobis"), lambda: Adversarial((16, 8), rate=0.01, batch=32, domain_weight=0.1)], ids=["linear", "euclidean", "mahalanobis", "adversarial"])
def test_classifiers_separate(spark, make):
    df, _, _ = xy(spark)
    assert accuracy(make().fit(df).scores(df)) > 0.9


def shrunk(z):
    """Ledoit and Wolf's estimate by its definition: the distance of the rows' own products from their mean, against that of
    the mean from the scaled identity."""
    n, d = z.shape
    mean = z.T @ z / n
    target = np.trace(mean) / d * np.eye(d)
    far = ((mean - target) ** 2).sum() / d
    near = min(sum(((np.outer(r, r) - mean) ** 2).sum() for r in z) / d / n**2, far)
    return near / far * target + (1 - near / far) * mean


@pytest.mark.parametrize("covariance", COVARIANCES)
def test_mahalanobis_is_closed_form(spark, covariance):
    df, x, y = xy(spark)
    model = Prototypes("mahalanobis", covariance, "raw").fit(df)
    means = [x[y == k].mean(axis=0) for k in (0, 1)]
    z, own = x - x.mean(axis=0), x[y == 1] - means[1]
    n, eye = len(x), np.eye(4)
    precision = {
        "bayes_ridge": lambda: 4 * np.linalg.inv((n - 1) * np.cov(x.T) + (np.trace(np.cov(x.T)) + 1e-6) * eye),
        "empirical": lambda: np.linalg.inv(np.cov(x.T, bias=True)) + 1e-6 * eye,
        "per_class": lambda: np.linalg.inv(np.cov(own.T, bias=True)) + 1e-6 * eye,
        "shared": lambda: np.linalg.inv(shrunk(z)) + 1e-6 * eye,
        "ledoit_wolf": lambda: np.linalg.inv(shrunk(z)) + 1e-6 * eye,
    }[covariance]()
    expected = -np.sqrt(np.einsum("ij,jk,ik->i", x - means[1], precision, x - means[1]))
    found = [r["score"] for r in model.scores(df).orderBy("run_id").collect()]
    assert np.allclose(found, expected)


def test_prototypes_need_both_classes(spark):
    df, _, _ = xy(spark)
    with pytest.raises(ValueError):
        Prototypes("euclidean").fit(df.where("y = 1"))


@pytest.mark.parametrize("scoring", ["softmax", "ratio", "raw"])
def test_models_come_back_from_storage(spark, tmp_path, scoring):
    df, _, _ = xy(spark)
    scores = lambda model: [r["score"] for r in model.scores(df).orderBy("run_id").collect()]
    model = Prototypes("mahalanobis", "per_class", scoring).fit(df)
    model.save(spark, f"{tmp_path}/p")
    assert scores(Prototypes.load(spark, f"{tmp_path}/p")) == scores(model)
    network = Adversarial((8,), epochs=3, batch=50, normalize="standard").fit(df)
    network.save(spark, f"{tmp_path}/a")
    assert scores(Adversarial.load(spark, f"{tmp_path}/a")) == scores(network)
    line = C.linear().fit(df)
    line.save(f"{tmp_path}/l")
    assert scores(C.linear().load(f"{tmp_path}/l")) == scores(line)


def test_adversarial_training(spark):
    rng = np.random.default_rng(0)
    y, domain = rng.integers(0, 2, 600), rng.integers(0, 2, 600)
    x = rng.normal(0, 0.3, (600, 2)) + np.column_stack([y * 2.0 - 1, domain * 2.0 - 1])
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), str(domain[i])) for i in range(600)], "run_id long, x array<double>, y long, dataset_id string")
    model = Adversarial((8,), rate=0.01, batch=64, epochs=40, patience=5, domain_weight=0.5).fit(df)
    history = model.history
    assert history[0]["reverse"] == 0 and all(a["reverse"] <= b["reverse"] <= 1 for a, b in zip(history, history[1:]))
    best = [h["f1"] for h in history].index(max(h["f1"] for h in history))
    assert history[best]["f1"] > 0.95 and len(history) in (best + 6, 40)
    assert accuracy(model.scores(df)) > 0.95


def test_network_gradients():
    rng = np.random.default_rng(1)
    for activation in ("gelu", "relu"):
        net = Network([3, 5, 2], activation, 0.0, False, rng)
        x, g = rng.normal(size=(4, 3)), rng.normal(size=(4, 2))
        net.forward(x)
        by_input, by_weight = net.backward(g)
        for array, slope in [*zip(net.parameters(), by_weight), (x, by_input)]:
            at = tuple(rng.integers(0, n) for n in array.shape)
            values = []
            for step in (1e-6, -1e-6):
                array[at] += step
                values.append((net.forward(x) * g).sum())
                array[at] -= step
            assert abs((values[0] - values[1]) / 2e-6 - slope[at]) < 1e-4


def test_top_indices():
    w = np.array([0.5, -2.0, 1.0, 1.0, 0.0])
    assert [top_indices(w, 2, d) for d in ("positive", "negative", "both", "abs")] == [[2, 3], [1, 4], [2, 3, 1, 4], [1, 2]]
    with pytest.raises(ValueError):
        top_indices(w, 2, "up")


def test_linear_is_the_optimum(spark):
    """Newton's method on the same penalised loss."""
    df, x, y = xy(spark)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    z = np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(len(x))])
    free, ridge = np.zeros(5), np.array([1, 1, 1, 1, 0]) / len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ free))
        gradient = z.T @ (w * (p - y)) / w.sum() + ridge * free
        free -= np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) / w.sum() + np.diag(ridge), gradient)
    assert np.allclose(C.linear().fit(df).weights(), free[:4], atol=1e-4)


def test_folds_in_one_pass_are_folds_one_by_one(spark):
    df, _, _ = xy(spark)
    for distance in ("euclidean", "cosine"):
        model = Prototypes(distance)
        at_once = {r["run_id"]: r["score"] for r in C.lodo_scores(model, df).collect()}
        for held in (0, 1, 2):
            for r in model.clone().fit(df.where(F.col("dataset_id") != held)).scores(df.where(F.col("dataset_id") == held)).collect():
                assert abs(at_once[r["run_id"]] - r["score"]) < 1e-9


def test_lodo_coefficients(spark):
    df, _, _ = xy(spark)
    baseline, held = C.lodo_coefficients(C.linear(), df)
    assert np.allclose([r["coef"] for r in baseline.orderBy("i").collect()], C.linear().fit(df).weights())
    one = C.linear().fit(df.where("dataset_id <> 2")).weights()
    assert np.allclose([r["coef"] for r in held.where("dataset_id = 2").orderBy("i").collect()], one)


def test_pca_is_centred(spark):
    df, x, _ = xy(spark)
    z, variances = U.pca(df, 2)
    found = np.array([r["z"] for r in z.orderBy("run_id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(found), np.abs((u * s)[:, :2]), atol=1e-6)
    assert U.cumulative(variances)[-1] <= 1.000001


def test_silhouette_needs_clusters(spark):
    df, _, _ = xy(spark, 40)
    assert U.silhouette(df.withColumn("cluster", F.lit(0).cast("long"))).first()[0] is None
    assert U.silhouette(df.withColumn("cluster", F.col("y"))).first()[0] > 0.3


@pytest.mark.parametrize("seed", [0, 1])
def test_dbscan_is_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(rng.uniform(-3, 3, 3), 0.4, (40, 3)) for _ in range(4)] + [rng.uniform(-4, 4, (30, 3)), np.repeat(rng.normal(0, 1, (1, 3)), 9, axis=0)])
    eps, least = 0.6, 5
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    root = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        root = np.where(core, np.where(near & core, root[None], len(x)).min(axis=1), -1)
    border = np.where(near & core, root[None], len(x)).min(axis=1)
    expected = np.where(core, root, np.where(border < len(x), border, -1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "run_id long, x array<double>")
    found = {r["run_id"]: r["cluster"] for r in U.dbscan(df, eps, least, storage.stored, block=20).collect()}
    assert [found[i] for i in range(len(x))] == expected.tolist()


def test_layout_keeps_neighbours(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (40, 10)) for c in (0, 4, 8)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "run_id long, x array<double>").repartition(3)
    found = L.sampled_layout(df, 100, 15, 300)
    assert found.count() == 100 and found.collect() == L.sampled_layout(df.repartition(5), 100, 15, 300).collect()
    z = np.array([[r["z0"], r["z1"]] for r in found.collect()])
    group = np.array([r["run_id"] // 40 for r in found.collect()])
    distances = L.squared_distances(z)
    np.fill_diagonal(distances, np.inf)
    assert (group[distances.argmin(axis=1)] == group).mean() > 0.97
    p = L.affinities(x, 15)
    own = p / p.sum(axis=1, keepdims=True)
    assert abs(np.exp(-(own * np.log(own)).sum(axis=1)).mean() - 15) < 6 and np.allclose(p, p.T)
    assert L.sampled_layout(df.limit(0)).count() == 0


def test_dbscan_noise(spark):
    rows = [(i, [float(i % 3) * 0.1, 0.0]) for i in range(6)] + [(9, [50.0, 0.0])]
    found = {r["run_id"]: r["cluster"] for r in U.dbscan(spark.createDataFrame(rows, "run_id long, x array<double>"), 0.5, 3, storage.stored).collect()}
    assert found == {**{i: 0 for i in range(6)}, 9: -1}


def test_npmi_undefined_is_zero(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "run_id long, y long")
    cells = spark.createDataFrame([(i, 0) for i in range(10)] + [(0, 1)], "run_id long, i long")
    found = {r["i"]: r["npmi"] for r in stats.npmi(cells, labels, 0.1).collect()}
    assert abs(found[0]) < 1e-6 and found[1] == 0.0


def prompts(spark):
    rows = [("p1", "d", "one two three"), ("p2", "d", "four five"), ("p3", "d", ""), ("p4", "d", "w " * 50)]
    return spark.createDataFrame(rows, "prompt_id string, dataset_id string, text string").withColumn("messages", F.lit(None).cast("array<struct<role:string,content:string>>")).withColumn("labels", F.lit('{"a": 1}'))


def test_ingestion_is_idempotent(spark):
    settings = I.Settings("toy", max_tokens=20)
    none = spark.createDataFrame([], "run_key string, processing_fingerprint string, status string")
    events, vectors = I.ingest(prompts(spark), none, I.toy_model(), settings, "2025-01-01")
    assert sorted((r["prompt_id"], r["status"]) for r in events.collect()) == [("p1", "completed"), ("p2", "completed"), ("p3", "failed"), ("p4", "skipped")]
    assert vectors.count() == 2
    again, _ = I.ingest(prompts(spark), events, I.toy_model(), settings, "2025-01-02")
    assert sorted(r["prompt_id"] for r in again.collect()) == ["p3", "p4"]
    assert I.pending(prompts(spark), events, settings, force=True).count() == 4


def test_fingerprints():
    a, b = I.Settings("m", positions=(1, -1)), I.Settings("m", positions=(-1, 1))
    assert a.fingerprint == b.fingerprint and len(a.fingerprint) == 16
    assert I.Settings("m", positions=("last", "first")).fingerprint != I.Settings("m", positions=("first", "last")).fingerprint


def test_evaluator_labels_win(spark):
    found = I.label(prompts(spark), lambda texts: [{"a": "2", "b": "x"} for _ in texts]).first()["labels"]
    assert sorted(found.strip("{}").split(",")) == ['"a":"2"', '"b":"x"']


def test_storage(spark, tmp_path):
    rows = spark.createDataFrame([("2025-01-01_aaaaaaaa", 3, 0, 1, 0.5), ("x", 4, 0, 1, 0.5)], "run_id string, layer int, position int, feature_idx int, activation_value double")
    storage.write_activations(rows, f"{tmp_path}/acts")
    assert storage.read_layer(spark, f"{tmp_path}/acts", 3).count() == 1
    storage.write_incidence(rows, f"{tmp_path}/incidence")
    assert {r["day"].isoformat() if hasattr(r["day"], "isoformat") else r["day"] for r in spark.read.parquet(f"{tmp_path}/incidence").select("day").distinct().collect()} == {"2025-01-01", "undated"}
    assert storage.storage_statistics(spark, f"{tmp_path}/acts").first()["bytes"] > 0
    cache, made = storage.MatrixCache(spark, f"{tmp_path}/cache"), []
    for dataset in ("A", "B", "A"):
        cache.load_or_make(lambda: made.append(dataset) or rows, dataset_id=dataset).count()
    assert made == ["A", "B"] and len(cache.entries()) == 2


def test_streaming(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 4, "completed") for i in range(20)], "event_no long, run_key long, status string")
    events.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = streaming.source(spark, f"{tmp_path}/in", events.schema)
        query = streaming.append_unprocessed(stream, f"{tmp_path}/runs", f"{tmp_path}/checkpoint")
        query.awaitTermination(120)
    assert sorted(r["run_key"] for r in spark.read.parquet(f"{tmp_path}/runs").collect()) == [0, 1, 2, 3]


def test_top_attended_takes_all_before_the_query(spark, tmp_path):
    rows = [(u, u * 4000 + i, "error" if i % 5 == 0 else "view", float((i * 37 + u) % 41)) for u in (1, 2, 3) for i in range(40)]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    expected = {(u, t) for u in (1, 2, 3) for _, t in sorted((-v, t) for q, t, kind, v in rows if q == u and kind != "error" and t < u * 4000 + 39)[:3]}
    assert {tuple(r) for r in catalog.load()[0]["TK8_top_attended"](spark, str(tmp_path)).collect()} == expected


def test_injected_characters_are_counted_once_a_text(spark, tmp_path):
    """The lengths are those of the prompts, whatever bytes a character has, and no plan counts the characters of every prompt."""
    texts = ["plain", "é\n漢字\n😀 x", "", "a\nü"]
    attacks = ["do", "naïve 😀", ""]
    spark.createDataFrame(list(enumerate(texts)) + [(9, texts[1])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(attacks)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = catalog.load()[0]["SRC9_JN12_injected"](spark, str(tmp_path))
    expected = {(i, k, p, len(t) + 1 + len(a)) for i, t in enumerate(texts) for k, a in enumerate(attacks) for p in ("start", "middle", "end")}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString().replace("octet_length(CASE", "bytes(CASE")
    assert "bytes(CASE" in plan and "length(CASE" not in plan


@pytest.mark.parametrize("number", [3, 10_001])
def test_injected_takes_every_context_and_attack(spark, number):
    contexts = {1: "a\nb\nc", 2: "one line", 3: "\nx", 4: ""}
    attacks = [(k, f"attack {k}") for k in range(number)]
    found = K.injected(spark.createDataFrame(list(contexts.items()), "idx long, context string"), spark.createDataFrame(attacks, "attack long, attack_str string").repartition(3))
    expected = {}
    for idx, context in contexts.items():
        lines = context.split("\n")
        for k, attack in attacks:
            for position, at in (("start", 0), ("middle", len(lines) // 2), ("end", len(lines))):
                expected[idx, k, position] = "\n".join([*lines[:at], attack, *lines[at:]])
    rows = found.collect()
    assert found.columns == ["idx", "context", "attack", "attack_str", "position", "user_prompt"] and len(rows) == len(expected)
    assert {(r["idx"], r["attack"], r["position"]): r["user_prompt"] for r in rows} == expected


def test_pivot_has_every_value(spark):
    df = spark.createDataFrame([("a", "en", 1), ("a", "es", 2), ("b", "xx", 3), ("b", "xx", 4), ("b", None, 5)], "d string, lang string, n long")
    found = metrics.pivoted(df, "d", "lang", None, "n")
    assert found.columns == ["d", "en", "es", "xx"] and sorted(tuple(r) for r in found.collect()) == [("a", 1, 2, None), ("b", None, None, 4)]


@pytest.mark.parametrize("name, module, operator", [("ML9_ML12_kmeans", U, "kmeans"), ("ML18_boosted", C, "boosted")])
def test_models_are_registered_with_their_defaults(spark, sf_dir, monkeypatch, name, module, operator):
    given = []
    whole = getattr(module, operator)
    monkeypatch.setattr(module, operator, lambda *a, **b: given.append(b) or whole(*a, **b))
    catalog.load()[0][name](spark, sf_dir)
    assert given == [{}]
