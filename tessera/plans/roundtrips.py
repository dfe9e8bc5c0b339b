"""Queries that write tables to scratch space, read them back and use what others plug in, with deterministic stand-ins."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import matrix as M
from ..operators import registry as R
from ..sources import files, storage
from ..sources import views as V
from ..sources.ledger import Ledger
from . import analyzers, boundary, inference, orchestrate
from . import ingest as I
from .catalog import query

I_ = f"WITH {V.INCIDENCE}"


def scratch(spark, name):
    return f"{storage.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _dated(spark, d):
    return V.incidence(spark, d).withColumn("run_id", F.concat(F.lit("2024-01-0"), (F.col("run_id") % 3 + 1).cast("string"), F.lit("_"), F.lower(F.lpad(F.hex("run_id"), 8, "0"))))


@query("SNK6_AG3_incidence", I_ + " SELECT '2024-01-0' || CAST(run_id % 3 + 1 AS VARCHAR) AS day, count(*) AS n, round(sum(v), 4) AS total, count(DISTINCT run_id) AS runs FROM incidence GROUP BY 1")
def incidence(spark, d):
    path = scratch(spark, "incidence")
    storage.write_incidence(_dated(spark, d), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"), F.countDistinct("run_id").alias("runs"))


@query("SNK7_activations", I_ + " SELECT run_id, feature_idx, round(v, 6) AS v FROM incidence WHERE layer = 1")
def activations(spark, d):
    path = scratch(spark, "activations")
    storage.write_activations(V.incidence(spark, d).withColumn("position", F.lit(0)), path)
    return storage.read_layer(spark, path, 1).select("run_id", "feature_idx", F.round("v", 6).alias("v"))


@query("SNK8_vectors", "SELECT vec_id AS run_id, CAST(len(embedding) AS INTEGER) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) AS last FROM embeddings")
def vectors(spark, d):
    path = scratch(spark, "vectors")
    rows = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("run_id"), F.lit(2).alias("layer"), F.lit(0).alias("position"), F.col("embedding").alias("vec"))
    storage.write_vectors(rows, path, chunk=10)
    back = storage.read_vectors(spark, path, 2)
    return back.select("run_id", F.size("vec").alias("width"), *(F.round(F.element_at("vec", at).cast("double"), 6).alias(name) for at, name in ((1, "first"), (-1, "last"))))


@query("SNK9_SNK14_json", "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def manifests(spark, d):
    """A JSON document for each of the 25 nations, written over several lines."""
    path = scratch(spark, "manifests")
    for row in V.table(spark, d, "nation").collect():
        storage.write_bytes(spark, f"{path}/{row['n_nationkey']}/manifest.json", json.dumps({"name": row["n_name"], "region": row["n_regionkey"]}, indent=1).encode())
    return storage.read_manifests(spark, f"{path}/*/manifest.json").select("name", "region")


@query("SNK14_analyzer_results", I_ + " SELECT layer, feature_idx, count(DISTINCT run_id) AS frequency FROM incidence GROUP BY layer, feature_idx ORDER BY frequency DESC, layer, feature_idx LIMIT 30")
def analyzer_results(spark, d):
    folder, analyzer = scratch(spark, "analysis"), analyzers.ComparisonAnalyzer(top_k=30)
    analyzer.save_results(analyzer.run(V.incidence(spark, d)), folder)
    return spark.read.option("header", True).schema("layer long, feature_idx long, frequency long, max_v double").csv(f"{folder}/frequency.csv").drop("max_v")


def _graphs(spark, d):
    feature = F.struct(F.col("layer").cast("int").alias("layer"), F.lit(0).alias("position"), F.col("feature_idx").cast("int").alias("feature_idx"), F.col("v").alias("influence"), F.col("v").alias("activation_value"), F.lit(None).cast("double").alias("logit_attribution"))
    tokens = F.array(F.lit(1).cast("long"))
    return V.incidence(spark, d).groupBy("run_id").agg(F.collect_list(feature).alias("features")).select(F.col("run_id").cast("string").alias("run_id"), tokens.alias("input_tokens"), tokens.alias("logit_tokens"), F.array(F.lit(0.5)).alias("logit_probabilities"), "features", F.lit(4).alias("n_layers"), F.lit(42).cast("long").alias("seed"))


@query("SNK10_SNK18_SC20_graphs", I_ + " SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(count(*) AS INTEGER) AS n, round(sum(v), 6) AS influence FROM incidence GROUP BY run_id")
def graphs(spark, d):
    path = scratch(spark, "graphs")
    files.write_graphs(_graphs(spark, d), path)
    back = files.graphs_from_json(files.graphs_to_json(files.read_graphs(spark, path)))
    total = F.aggregate("features", F.lit(0.0), lambda s, f: s + f["influence"])
    return back.select("run_id", F.size("features").alias("n"), F.round(total, 6).alias("influence"))


@query("SNK15_matrix_cache", I_ + " SELECT 'top' AS name, count(*) AS n FROM (SELECT DISTINCT run_id, layer, feature_idx FROM incidence JOIN (SELECT layer, feature_idx FROM (SELECT layer, feature_idx, count(DISTINCT run_id) AS f FROM incidence GROUP BY layer, feature_idx) ORDER BY f DESC, layer, feature_idx LIMIT 5) USING (layer, feature_idx))")
def matrix_cache(spark, d):
    cache = storage.MatrixCache(spark, scratch(spark, "cache"))
    make = lambda: M.feature_matrix(V.incidence(spark, d), 5)
    cache.load_or_make(make, k=5)
    return cache.load_or_make(make, k=5).agg(F.count(F.lit(1)).alias("n")).select(F.lit("top").alias("name"), "n")


@query("SNK16_bytes", "SELECT r_name AS name, CAST(strlen(r_name) AS BIGINT) AS n FROM region")
def stored_bytes(spark, d):
    root = scratch(spark, "bytes")
    storage.makedirs(spark, root)
    for row in V.table(spark, d, "region").select("r_name").collect():  # five rows
        storage.write_bytes(spark, f"{root}/{row['r_name'].replace(' ', '_')}", row["r_name"].encode())
    listed = spark.read.format("binaryFile").load(root)
    return listed.select(F.col("content").cast("string").alias("name"), F.col("length").alias("n"))


@query("SRC7_case_files", "SELECT n_name AS name, 'dh' AS attack_type FROM nation")
def case_files(spark, d):
    root = scratch(spark, "cases")
    cases = [row.asDict() for row in V.table(spark, d, "nation").select(F.col("n_name").alias("name")).collect()]  # 25 rows
    storage.write_bytes(spark, f"{root}/test_cases_dh_base.json", json.dumps(cases).encode())
    return files.read_cases(spark, root, ["dh", "ds"], "base").select("name", "attack_type")


@query("SRC20_SRC21_OR8_run_data", "SELECT '7' AS run_id, CAST(len(embedding) AS INTEGER) AS width, 'en' AS lang FROM embeddings WHERE vec_id = 7")
def run_data(spark, d):
    """One run through the store's accessor: its row, labels and vectors."""
    path = scratch(spark, "store")
    storage.write_vectors(V.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("run_id"), F.lit(0).alias("layer"), F.lit(0).alias("position"), F.col("embedding").alias("vec")), path)
    events = V.xy(spark, d).select(F.col("run_id").cast("string").alias("run_id"), F.lit(1).cast("long").alias("event_no"), F.lit("completed").alias("status"), F.col("run_id").cast("string").alias("run_key"), F.lit("A").alias("dataset_id"), F.lit("t").alias("timestamp"), F.lit('{"lang": "en"}').alias("prompt_labels"))
    artifacts = events.select("run_id", F.lit("vectors").alias("kind"), F.lit(path).alias("path"), F.lit(1).alias("size_bytes"), F.lit("t").alias("created_at"))
    run = files.Store(events, artifacts, status="completed").run("7")
    return run.vectors(0).select(F.lit(run.row["run_id"]).alias("run_id"), F.size("vec").alias("width"), F.lit(run.labels["lang"]).alias("lang"))


CONFIG = "datasets:\n  advbench:\n    num_prompts: 40\n  enron: {}\n  dolly:\n    enabled: false\n"


def _load(spark, d):
    docs = V.table(spark, d, "documents")
    return lambda name: docs.where(F.col("doc_id") % 2 == int(name == "enron")).select(F.col("doc_id").alias("idx"), F.col("text").alias("prompt"), "text")


@query("SRC16_PRJ4_configured_prompts", "SELECT dataset_id, n FROM (SELECT 'advbench' AS dataset_id, least(40, count(*)) AS n FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'enron', count(*) FROM documents WHERE doc_id % 2 = 1)")
def configured(spark, d):
    """Both halves of the documents as two datasets; the limit is the configuration's."""
    rows = orchestrate.prompts(files.read_config(CONFIG), _load(spark, d))
    return rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))


@query("OR3_OR4_ingestion", r"SELECT 'x' AS dataset_id, CASE WHEN len(regexp_split_to_array(text, '\s+')) > 200 THEN 'skipped' WHEN regexp_matches(text, '\S') THEN 'completed' ELSE 'failed' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def ingestion(spark, d):
    prompts = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("prompt_id"), F.lit("x").alias("dataset_id"), F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"), F.lit("{}").alias("labels"), F.lit(None).cast("string").alias("tools"), "text")
    pipeline = orchestrate.FullIngestionPipeline(spark, scratch(spark, "ingestion"), I.toy_model(), I.Settings("toy", max_tokens=200))
    pipeline.run(prompts, day="2024-01-01")
    pipeline.run(prompts.where("prompt_id LIKE '%0'"), day="2024-01-02")  # nothing is left of these but what failed or was skipped
    return pipeline.known().groupBy("dataset_id", "status").agg(F.countDistinct("prompt_id").alias("n"))


@query("UX2_chunk_evaluator", "SELECT doc_id, round(least(length(text), 100) / 100.0, 6)::DOUBLE AS pg_score, CAST(length(text) >= 50 AS INTEGER) AS pg_label FROM documents")
def chunk_evaluator(spark, d):
    """A classifier that finds a chunk the worse the longer it is."""
    prompts = V.table(spark, d, "documents").select(F.col("doc_id").alias("prompt_id"), "text", F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"))
    out = boundary.chunk_evaluator(prompts, lambda texts: [1 - len(t) / 100 for t in texts], chunk_chars=100)
    return out.select(F.col("prompt_id").alias("doc_id"), F.round("pg_score", 6).alias("pg_score"), "pg_label")


@query("UX2_chunk_evaluator_without_ids", "SELECT CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 END AS id, count(*) AS n, round(sum(round(least(length(text), 100) / 100.0, 6)), 4)::DOUBLE AS score FROM documents GROUP BY 1")
def chunk_evaluator_without_ids(spark, d):
    """Prompts a third of which have no id, the others ids that repeat: each is scored."""
    some_id = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7)
    prompts = V.table(spark, d, "documents").select(some_id.alias("prompt_id"), "text", F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"))
    out = boundary.chunk_evaluator(prompts, lambda texts: [1 - len(t) / 100 for t in texts], chunk_chars=100)
    return out.groupBy(F.col("prompt_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round("pg_score", 6)), 4).alias("score"))


@query("OR3_OR4_interrupted", "SELECT count(*) AS events, count(*) AS vectors, count(DISTINCT vec_id) AS runs FROM embeddings")
def interrupted(spark, d):
    """A call that ended before its batch counted, and the call that repeats it: every vector is there once."""
    rows = V.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("run_id"), F.lit(0).alias("position"), F.col("embedding").alias("vec"))
    ledger = Ledger(spark, scratch(spark, "interrupted"))
    half = ledger.new_batch()
    rows.where("vec IS NOT NULL").write.parquet(f"{ledger.root}/vectors/batch_id={half}")
    ledger.append(ledger.new_batch(), vectors=rows, events=rows.select("run_id", F.lit("completed").alias("status")))
    n = F.count(F.lit(1))
    counts = ledger.read("events").agg(n.alias("events"), F.countDistinct("run_id").alias("runs"))
    return counts.crossJoin(F.broadcast(ledger.read("vectors").agg(n.alias("vectors"))))


@query("UX2_guard_evaluator", "SELECT conv_id, CASE WHEN bool_or(contains(text, 'zq')) THEN 'unsafe' ELSE 'safe' END AS verdict FROM conversations GROUP BY conv_id")
def guard_evaluator(spark, d):
    """A guard that finds chats with zq in them unsafe."""
    out = boundary.guard_evaluator(V.messages(spark, d), lambda chats: ["unsafe\nS1" if "zq" in chat else "safe" for chat in chats])
    return out.select("conv_id", F.lower("lg_label").alias("verdict"))


@query("UX2_injection_evaluator", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN CAST(contains(text, 'a') AS INTEGER) END AS hit FROM documents")
def injection_evaluator(spark, d):
    labels = F.when(F.col("doc_id") % 3 > 0, F.lit('{"attacker_tools": ["a", "b"], "user_tool": "u"}')).otherwise(F.lit("{}"))
    prompts = V.table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("<tools>a</tools>")).alias("generated"), labels.alias("labels"))
    out = boundary.tool_injection_evaluator(prompts, lambda output, tool, *_: {"hit": int(tool in output)})
    return out.select("doc_id", F.get_json_object("injection", "$.hit").cast("int").alias("hit"))


@query("UX5_sparse_features", "SELECT run_id, feature_idx, round(v, 6) AS v FROM (SELECT vec_id AS run_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS feature_idx, CAST(unnest(embedding) AS DOUBLE) - 0.1 AS v FROM embeddings) WHERE v > 0")
def sparse_features(spark, d):
    """An encoder with unit weights and a bias of -0.1."""
    rows = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("run_id"), F.lit(0).alias("position"), F.col("embedding").cast("array<double>").alias("vec"))
    width = rows.agg(F.max(F.size("vec"))).first()[0]
    return boundary.sparse_encode(rows, np.eye(width), np.full(width, -0.1)).select("run_id", "feature_idx", F.round("v", 6).alias("v"))


class _Length:
    """A classifier that scores texts, as their stand-in vector, by its first component."""

    def scores(self, rows):
        return rows.withColumn("score", F.col("x")[0])


@query("OR5_inference", "SELECT doc_id, least(length(text), 500) / 500.0::DOUBLE AS score, CAST(length(text) >= 250 AS INTEGER) AS prediction FROM documents")
def infer(spark, d):
    """A model whose vector is the text's length, up to 500."""
    model = lambda texts: [{0: np.array([min(len(t), 500) / 500])} for t in texts]
    pipeline = inference.InferencePipeline(model, inference.RawExtractor(), _Length(), 0.5, chat=False)
    return pipeline.classify(V.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "score", "prediction")


@query("SRC18_remote_features", I_ + " SELECT layer, feature_idx, CASE WHEN feature_idx % 2 = 0 THEN 'even' END AS description FROM incidence GROUP BY layer, feature_idx")
def remote_features(spark, d):
    """Features looked up one by one and kept; the service knows the even ones."""
    features = V.incidence(spark, d).select("layer", "feature_idx").distinct()
    fetch = lambda layer, feature: (["even"], [0.5]) if feature % 2 == 0 else None
    interpreter = boundary.RemoteInterpreter(fetch, scratch(spark, "features"), per_second=1e6)
    interpreter.interpret(features)
    return interpreter.interpret(features).select("layer", "feature_idx", "description")


@query("SC21_fingerprint", """SELECT doc_id, substr(sha1('{"layers": [' || least(doc_id % 4, 2) || ', ' || greatest(doc_id % 4, 2) || '], "max_tokens": ' || n_chars || ', "model": "' || substr(sha1(lang), 1, 12) || '", "positions": ['
    || CASE WHEN doc_id % 3 = 0 THEN '"last", 0' WHEN doc_id % 11 < 3 THEN (doc_id % 11) || ', 3' ELSE '3, ' || (doc_id % 11) END || '], "seed": ' || doc_id % 5 || '}'), 1, 16) AS fingerprint FROM documents""")
def fingerprint(spark, d):
    """The settings of every document's run, some with named positions."""
    positions = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("last"), F.lit("0"))).otherwise(F.array((F.col("doc_id") % 11).cast("string"), F.lit("3")))
    model = F.substring(F.sha1("lang"), 1, 12)
    found = R.fingerprint(model, F.array(F.col("doc_id") % 4, F.lit(2).cast("long")), positions, F.col("n_chars"), F.col("doc_id") % 5)
    return V.table(spark, d, "documents").select("doc_id", found.alias("fingerprint"))


@query("SC19_class_names", r"""WITH n AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || 'HFDataset' AS name FROM part)
    SELECT p_partkey, lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake FROM n""")
def class_names(spark, d):
    """The names of parts as a class would be named."""
    name = F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.lit("HFDataset"))
    return V.table(spark, d, "part").select("p_partkey", files.snake_cased(name).alias("snake"))


@query("PRJ3_resolved_layers", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '0,1,2,3' WHEN doc_id % 4 = 2 THEN '2' ELSE least(doc_id % 4, 2) || ',' || greatest(doc_id % 4, 2) END AS layers FROM documents")
def resolved(spark, d):
    """Layers that each run asks for, by number or all, of four."""
    specs = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("all"), F.lit("2"))).otherwise(F.array((F.col("doc_id") % 4).cast("string"), F.lit("2")))
    return V.table(spark, d, "documents").select("doc_id", F.array_join(M.resolved_layers(specs, F.lit(4)).cast("array<string>"), ",").alias("layers"))


@query("PRJ7_benign_classes", "SELECT n_regionkey, coalesce(min(n_nationkey) FILTER (n_nationkey % 4 = 3), 0) AS benign FROM nation GROUP BY n_regionkey")
def benign_classes(spark, d):
    """Regions as models whose classes are their nations; each fourth nation's is called safe."""
    name = F.when(F.col("n_nationkey") % 4 == 3, F.lit("Safe")).otherwise(F.col("n_name"))
    return files.benign_classes(V.table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("class"), name.alias("name")), "n_regionkey")


@query("SRC1_UX10_iterated", "SELECT count(*) AS n, CAST(sum(length(n_name)) AS BIGINT) AS chars FROM nation")
def iterated(spark, d):
    from ..sources.hub import HubTable

    source = HubTable(spark, d, "org/nation", layout="{root}/{name}.parquet")
    return spark.createDataFrame([(len(source), sum(len(row["n_name"]) for row in source))], "n long, chars long")
