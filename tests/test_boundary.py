"""File sources, the store accessor and what others plug in."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import classify as C
from tessera.plans import boundary as B
from tessera.sources import converters as K
from tessera.sources import files


def test_cases_and_tools(spark, tmp_path):
    case = {"User Tool": "KitT", "Attacker Tools": ["KitU", "none"], "User Instruction": "u", "Attacker Instruction": "a", "Tool Parameters": "{}", "Tool Response": "r", "Attack Type": "t"}
    (tmp_path / "test_cases_dh_base.json").write_text(json.dumps([case, case]))
    raw = files.read_cases(spark, str(tmp_path), ["dh", "ds"], "base")
    assert raw.count() == 2 and files.read_cases(spark, str(tmp_path / "no"), ["dh"], "base") is None
    names = {"User Tool": "user_tool", "Attacker Tools": "attacker_tools", "User Instruction": "user_instruction", "Attacker Instruction": "attacker_instruction", "Tool Parameters": "tool_parameters", "Tool Response": "tool_response", "Attack Type": "attack_category"}
    cases = raw.withColumnsRenamed(names).withColumn("idx", F.monotonically_increasing_id())
    parameter = ("p", "array", "d", None, True)
    kits = spark.createDataFrame([("Kit", [("T", "does", [parameter]), ("U", "more", [])])], "toolkit string, tools array<struct<name:string,summary:string,parameters:array<struct<name:string,type:string,description:string,default:string,required:boolean>>>>")
    prompt = files.converter("InjecagentDataset").convert(K.with_tools(cases, K.tool_dictionary(kits))).orderBy("prompt_id").first()
    tools = json.loads(prompt["tools"])
    assert prompt["prompt_id"].startswith("injecagent_dh_base:dh_") and [t["function"]["name"] for t in tools] == ["T", "U"]
    assert tools[0]["function"]["parameters"] == {"type": "object", "properties": {"p": {"type": "array", "description": "d", "items": {"type": "string"}}}, "required": ["p"]}
    assert "required" not in tools[1]["function"]["parameters"] and [m["role"] for m in prompt["messages"]] == ["system", "user", "assistant", "tool"]


def test_config():
    assert files.read_config("datasets:\n  advbench:\n    num_prompts: 5\n")["datasets"]["advbench"]["num_prompts"] == 5
    for bad in ("datasets:\n  nothing: {}\n", "datasets:\n  advbench:\n    num_prompts: 0\n"):
        with pytest.raises(ValueError):
            files.read_config(bad)
    assert [files.prompt_limit(*a) for a in ((3, 4, 5), (None, 4, 5), (None, None, None))] == [3, 4, -1]
    assert files.snake_case("LLMailDataset") == "ll_mail_dataset" and files.benign_class({0: "x", 2: "safe"}) == 2 and files.benign_class({1: "x"}) == 0


def test_store(spark):
    events = spark.createDataFrame([("r", 1, "pending", "k", "A", None), ("r", 2, "completed", None, None, None)], "run_id string, event_no long, status string, run_key string, dataset_id string, timestamp string")
    artifacts = spark.createDataFrame([("r", "graph", "old", 1, "1"), ("r", "graph", "new", 2, "2")], "run_id string, kind string, path string, size_bytes long, created_at string")
    store = files.Store(events, artifacts, status="completed")
    assert store.runs is store.runs and store.runs.first()["dataset_id"] == "A" and store.artifact("r", "graph") == "new"
    with pytest.raises(LookupError):
        store.artifact("r", "other")


def test_graphs_round_trip(spark, tmp_path):
    feature = (10, 31, 5421, 0.034, 2.47, 0.021)
    graphs = spark.createDataFrame([("r", [1, 2], [42], [0.5], [feature], 28, 42)], __import__("tessera.schema", fromlist=["GRAPHS"]).GRAPHS)
    files.write_graphs(graphs, f"{tmp_path}/g")
    assert files.read_graphs(spark, f"{tmp_path}/g").collect() == graphs.collect()
    one = graphs.select(F.col("features")[0].alias("f")).select("f", files.as_map("f", ["layer", "influence"]).alias("m")).select(files.from_map("m", {"layer": "int", "influence": "double"}).alias("g")).first()["g"]
    assert (one["layer"], one["influence"]) == (10, 0.034)


def chats(spark):
    return spark.createDataFrame([("p", [("system", "be good"), ("user", "bad thing"), ("user", " ")], None), ("q", [("user", "hi")], "x" * 5000)], "prompt_id string, messages array<struct<role:string,content:string>>, text string")


def test_evaluators(spark):
    guarded = B.guard_evaluator(chats(spark), lambda texts: ["unsafe\nS1" if "bad" in t else "safe" for t in texts]).orderBy("prompt_id").collect()
    assert [(r["lg_label"], r["lg_categories"]) for r in guarded] == [("UNSAFE", ["S1"]), ("SAFE", [])]
    judged = B.judge_evaluator(chats(spark), lambda texts: ["SAFE" if "[USER]: hi" in t else "?" for t in texts]).orderBy("prompt_id").collect()
    assert [r["lj_label"] for r in judged] == [None, "SAFE"]
    scored = B.chunk_evaluator(chats(spark), lambda texts: [len(t) / 2000 for t in texts]).orderBy("prompt_id").collect()
    assert [r["pg_label"] for r in scored] == [1, 1] and scored[1]["pg_score"] == 0.5


def test_sparse_encoding(spark):
    vectors = spark.createDataFrame([("r", 0, [1.0, -1.0])], "run_id string, position int, vec array<float>")
    found = B.sparse_encode(vectors, np.array([[1.0, 0, -1], [0, 1.0, 0]]), np.array([0.5, 0, 0])).collect()
    assert [(r["feature_idx"], r["v"]) for r in found] == [(0, 1.5)]


def test_interpretation(spark):
    known = spark.createDataFrame([(0, 1, ["a", "b"], list(range(20)))], "layer int, feature_idx int, explanations array<string>, activations array<int>")
    rows = B.TableInterpreter(known).interpret(spark.createDataFrame([(0, 1), (0, 2)], "layer int, feature_idx int")).orderBy("feature_idx").collect()
    assert (rows[0]["description"], len(rows[0]["activations"]), rows[0]["source"]) == ("a", 10, "table") and rows[1]["description"] is None


def test_models_are_saved(spark, tmp_path):
    from pyspark.ml import PipelineModel

    xy = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(20)], "run_id long, x array<double>, y long")
    C.linear().fit(xy).save(f"{tmp_path}/m")
    assert len(PipelineModel.load(f"{tmp_path}/m").stages) == 2


def test_inference_pipeline(spark):
    from tessera.operators.checkpoints import top_indices
    from tessera.plans import inference

    def model(texts):
        return [ValueError("no") if "bad" in t else {0: np.array([1.0, -1.0]), 1: np.array([float(len(t)), 2.0])} for t in texts]

    rows = [(f"p{i}", t) for i, t in enumerate(["a", "abc", "bad", None, ""])]
    prompts = spark.createDataFrame(rows, "prompt_id string, text string")
    for position, expected in (("last", [3.0, 2.0]), ("mean", [2.0, 0.5]), ("max", [3.0, 2.0]), (0, [1.0, -1.0]), ([0, -1], [1.0, -1.0, 3.0, 2.0])):
        x = {r["prompt_id"]: r["x"] for r in inference.extracted(prompts, model, inference.RawExtractor(position), chat=False).collect()}
        assert x["p1"] == expected and x["p2"] is None and x["p3"] == x["p4"]
    assert inference.extracted(prompts, model, inference.RawExtractor(5), chat=False).where("x IS NOT NULL").count() == 0

    class First:
        def scores(self, rows):
            return rows.withColumn("score", F.col("x")[0])

    sparse = inference.SparseExtractor(np.array([[1.0, -1.0, 0.5], [0.0, 0.0, -1.0]]), np.zeros(3))
    found = inference.InferencePipeline(model, sparse, First(), 1.0, chat=False).classify(prompts)
    by_id = {r["prompt_id"]: r for r in found.collect()}
    assert by_id["p1"]["features"] == [3.0, 0.0, 0.0] and by_id["p1"]["is_malicious"] and by_id["p3"]["prediction"] == 0
    assert by_id["p2"]["score"] is None and by_id["p2"]["prediction"] is None and len(by_id) == 5
    weights = np.array([2.0, 1.0, -3.0])
    for direction in ("positive", "negative", "abs"):
        top = inference.top_influences(found.where("prompt_id = 'p1'"), weights, 2, direction).orderBy("rank").collect()
        assert [r["feature_idx"] for r in top] == top_indices(weights * np.array([3.0, 0.0, 0.0]), 2, direction)
    as_chat = inference.extracted(prompts, lambda texts: [{0: np.array([float("abc" in t and t != "abc")])} for t in texts], inference.RawExtractor())
    assert {r["prompt_id"]: r["x"] for r in as_chat.collect()}["p1"] == [1.0]


def test_remote_features_are_fetched_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def fetch(layer, feature):
        calls.add(1)
        return (["odd"], [1.0] * 12) if feature % 2 else None

    features = spark.createDataFrame([(0, i) for i in range(6)] + [(0, 1)], "layer int, feature_idx int")
    remote = B.RemoteInterpreter(fetch, f"{tmp_path}/cache", per_second=1000)
    first = remote.interpret(features).collect()
    assert calls.value == 6 and sorted(r["feature_idx"] for r in first if r["description"]) == [1, 1, 3, 5]
    remote.interpret(features.unionByName(spark.createDataFrame([(0, 9)], features.schema))).collect()
    assert calls.value == 7
    slow = B.RemoteInterpreter(lambda layer, feature: None, f"{tmp_path}/slow", per_second=20)
    import time

    began = time.monotonic()
    slow.interpret(features).collect()
    assert time.monotonic() - began > 5 / 20


def test_model_interpreter(spark):
    contexts = spark.createDataFrame([(0, 1, f"t{i}", float(i)) for i in range(9)], "layer int, feature_idx int, text string, v double")
    features = spark.createDataFrame([(0, 1), (0, 2)], "layer int, feature_idx int")
    found = {r["feature_idx"]: r["description"] for r in B.ModelInterpreter(lambda asked: [q.splitlines()[1] for q in asked], contexts, 2).interpret(features).collect()}
    assert found == {1: "t8", 2: None}


def test_injection_evaluator(spark):
    rows = [("echo <tools>Send</tools> x", '{"attacker_tools": ["Send"]}'), ("<tool_call>Send</tool_call>", '{"attacker_tools": ["Send", "B"], "user_tool": "U", "attacker_instruction": "I"}'), (None, '{"attacker_tools": ["Send"]}'), ("Send", "{}"), ("boom", '{"attacker_tools": ["Send"]}'), ("Send", None)]
    prompts = spark.createDataFrame(rows, "generated string, labels string")

    def judge(output, target, tools, user_tool, instruction):
        if output == "boom":
            raise ValueError
        return {"eval": "succ" if target in output else "unsucc", "tools": len(tools), "user": user_tool + instruction}

    found = [r["injection"] and json.loads(r["injection"]) for r in B.tool_injection_evaluator(prompts, judge).collect()]
    assert found == [{"eval": "unsucc", "tools": 1, "user": ""}, {"eval": "succ", "tools": 2, "user": "UI"}, None, None, None, None]


def test_storage(spark, tmp_path):
    from tessera.sources import storage

    storage.makedirs(spark, f"{tmp_path}/d")
    storage.write_bytes(spark, f"{tmp_path}/d/x", b"\x00\xff")
    assert storage.exists(spark, f"{tmp_path}/d/x") and storage.read_bytes(spark, f"{tmp_path}/d/x") == b"\x00\xff"
    vectors = spark.createDataFrame([("r", 1, 0, [float(i) for i in range(2500)]), ("s", 1, 0, [])], "run_id string, layer int, position int, vec array<float>")
    storage.write_vectors(vectors, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").count() == 4
    assert {r["run_id"]: len(r["vec"]) for r in storage.read_vectors(spark, f"{tmp_path}/v", 1).collect()} == {"r": 2500, "s": 0}
    cache = storage.MatrixCache(spark, f"{tmp_path}/c")
    for k in (1, 2):
        cache.load_or_make(lambda: vectors, k=k)
    cache.clear(k=1)
    assert cache.entries() == [cache.key(k=2)]
    cache.clear()
    assert cache.entries() == []
    storage.write_incidence(spark.createDataFrame([("2024-01-02_00000001", 1), ("2024-01-02_00000002", 1)], "run_id string, v int"), f"{tmp_path}/i")
    (tmp_path / "runs" / "2024-01-02_0000000a").mkdir(parents=True)
    (tmp_path / "runs" / "2024-01-02_0000000a" / "f").write_bytes(b"abc")
    assert tuple(storage.storage_statistics(spark, f"{tmp_path}/runs").first()) == (1, 3, 1)


def test_analyzers(spark, tmp_path):
    from tessera.plans import analyzers

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(k * 6, 1, (30, 3)) for k in (0, 1)])
    rows = spark.createDataFrame([(i, v.tolist(), int(i >= 30), i % 2) for i, v in enumerate(x)], "run_id long, x array<double>, y long, dataset_id long")
    out = analyzers.UnsupervisedAnalyzer(n_components=2, n_clusters=2).run(rows.select("run_id", "x"))
    assert sorted(r["n"] for r in out["cluster_sizes"].collect()) == [30, 30] and out["silhouette"] > 0.6
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    share = np.linalg.svd(z, compute_uv=False) ** 2
    assert np.allclose(out["explained_variance"], (share / share.sum())[:2]) and np.allclose(out["cumulative_variance"], np.cumsum(share / share.sum())[:2])
    analyzers.UnsupervisedAnalyzer(2, n_clusters=2).save_results(out, f"{tmp_path}/u")
    assert json.loads((tmp_path / "u" / "summary.json").read_text())["n_prompts"] == 60
    pairs = analyzers.DirectionsAnalyzer(10).run_pairwise(rows, [0, 1])
    analyzers.DirectionsAnalyzer().save_results(pairs[0, 1], f"{tmp_path}/d")
    from tessera.sources import storage

    assert np.allclose(storage.read_npy(spark, f"{tmp_path}/d/vector.npy"), pairs[0, 1]["vector"]) and abs(np.linalg.norm(pairs[0, 1]["vector"]) - 1) < 1e-6
    assert set(pairs) == {(0, 1)} and pairs[0, 1]["histogram"].agg(F.sum("n")).first()[0] == 30
    dense = analyzers.dense(spark.createDataFrame([(1, 0, 2.0), (1, 2, 1.0), (1, 2, 1.0)], "run_id long, i long, v double"), 4)
    assert dense.first()["x"] == [2.0, 0.0, 2.0, 0.0]


def test_command_line(spark, tmp_path):
    from tessera import cli

    (tmp_path / "config.yaml").write_text("num_prompts: -1\ndatasets:\n  advbench:\n    num_prompts: 2\n  enron: {}\n  dolly:\n    enabled: false\n")
    spark.createDataFrame([(i, f"say {i}") for i in range(5)], "idx long, prompt string").write.parquet(f"{tmp_path}/advbench.parquet")
    spark.createDataFrame([("mail",), ("mail",), ("other",)], "text string").write.parquet(f"{tmp_path}/enron.parquet")
    common = [str(tmp_path / "config.yaml"), "--data", str(tmp_path), "--root", f"{tmp_path}/root"]
    counted = lambda *more: {tuple(r) for r in cli.run(spark, [*more]).collect()}
    assert {r[0]: r[1:] for r in counted("plan", *common)}["advbench"] == (2, 2)
    assert ("advbench", "completed", 2) in counted("ingest", *common)
    assert {r[0]: r[2] for r in counted("plan", *common)} == {"advbench": 0, "enron": 0}
    assert ("advbench", "completed", 1) in counted("ingest", *common, "--shard", "0/2", "--dataset", "advbench", "--num-prompts", "1", "--force")
    assert counted("statistics", "--root", f"{tmp_path}/root").pop()[0] > 0
    with pytest.raises(ValueError):
        cli.run(spark, ["plan", *common, "--dataset", "none"])


def test_labels_only(spark, tmp_path):
    from tessera.plans import ingest, orchestrate

    rows = spark.createDataFrame([("p1", "d", None, "{}", None, "x"), ("p2", "d", None, "{}", None, "yy")], __import__("tessera.schema", fromlist=["PROMPTS"]).PROMPTS)
    pipeline = orchestrate.LabelsOnlyIngestionPipeline(spark, str(tmp_path), lambda texts: [{"n": len(t)} for t in texts], ingest.Settings("toy"))
    assert pipeline.run(rows).first()["n"] == 2 and pipeline.run(rows).count() == 0
    labels = {r["prompt_id"]: json.loads(r["labels"]) for r in pipeline.ledger.read("labels").collect()}
    assert {k: int(v["n"]) for k, v in labels.items()} == {"p1": 1, "p2": 2}


def double(prompts, factor=2):
    return prompts.withColumn("n", F.lit(factor))


def test_construction_by_name(spark):
    prompts = spark.createDataFrame([("a",)], "prompt_id string")
    assert B.evaluator("tests.test_boundary:made")(prompts).first()["n"] == 2
    assert files.construct("tests.test_boundary:Made", {}, factor=3).factor == 3
    judged = B.evaluator("LlamaJudgeEvaluator", lambda texts: ["UNSAFE"] * len(texts))(chats(spark))
    assert {r["lj_label"] for r in judged.collect()} == {"UNSAFE"}
    with pytest.raises(ValueError):
        B.evaluator("nothing")


def made():
    return double


class Made:
    def __init__(self, factor):
        self.factor = factor


def test_chunks_become_objects_call_by_call(spark):
    """No call gets more than CHUNKS of them, and Python at most CHUNKS rows at once."""
    lists = pa.array([["a"] * 3, [], None, ["bb"] * 5000, ["", "ccc"]], pa.list_(pa.string()))
    sizes = []

    def classify(texts):
        sizes.append(len(texts))
        return [1 - len(t) / 10 for t in texts]

    assert np.allclose(B.worst_of(lists, classify).to_pylist(), [0.1, 0, 0, 0.2, 0.3])
    assert sum(sizes) == 5007 and max(sizes) <= B.CHUNKS
    assert B.worst_of(lists.slice(0, 0), classify).to_pylist() == []
    assert np.allclose(B.worst_of(lists.slice(3), classify).to_pylist(), [0.2, 0.3])
    rows = spark.range(5000, numPartitions=1).select(F.col("id").alias("prompt_id"), F.lit("x").alias("text"), F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"))
    out = B.chunk_evaluator(rows, lambda texts: [1 / (1 + len(texts))] * len(texts))
    assert out.where(F.col("pg_score") > 1 - 1 / (1 + B.CHUNKS) + 1e-9).isEmpty() and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= B.CHUNKS
