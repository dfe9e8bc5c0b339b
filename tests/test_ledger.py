"""Rows that could be lost, merged or doubled: batches that end half-way, ids, streams, repeated rows, model calls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import registry as R
from tessera.plans import boundary as B
from tessera.plans import inference, ingest, orchestrate
from tessera.sources import converters as K
from tessera.sources.ledger import Ledger
from tessera.streaming import ingest as streaming

PROMPTS = "prompt_id string, dataset_id string, messages array<struct<role:string,content:string>>, labels string, tools string, text string"


def prompts(spark, n=4):
    return spark.createDataFrame([(f"p{i}", "d", None, "{}", None, f"text number {i}") for i in range(n)], PROMPTS)


@pytest.mark.parametrize("table", ["vectors", "events", "batches"])
def test_a_call_that_ends_between_its_tables_is_done_again(spark, tmp_path, monkeypatch, table):
    pipeline = orchestrate.FullIngestionPipeline(spark, str(tmp_path), ingest.toy_model(), ingest.Settings("toy"))
    pipeline.run(prompts(spark, 2), day="2024-01-01")
    writer = type(spark.range(1).write)
    whole = writer.parquet

    def fails(self, path, *args, **kwargs):
        if f"/{table}" in path:
            raise OSError("lost")
        return whole(self, path, *args, **kwargs)

    monkeypatch.setattr(writer, "parquet", fails)
    with pytest.raises(OSError):
        pipeline.run(prompts(spark), day="2024-01-02")
    monkeypatch.undo()
    assert pipeline.known().count() == pipeline.vectors().count() == 2
    assert {r["status"]: r["n"] for r in pipeline.run(prompts(spark), day="2024-01-03").collect()} == {"completed": 2}
    events, vectors = pipeline.known().collect(), pipeline.vectors().collect()
    assert len(events) == len({r["prompt_id"] for r in events}) == 4
    assert sorted(r["run_id"] for r in vectors) == sorted(r["run_id"] for r in events)
    left = pipeline.ledger.purge()
    assert len(left) == {"vectors": 0, "events": 1, "batches": 2}[table] and pipeline.known().count() == pipeline.vectors().count() == 4


def test_a_batch_is_written_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.read("t") is None and ledger.purge() == []
    for n in (3, 5):
        ledger.append("b1", t=spark.range(n))
    assert ledger.read("t").count() == 3 and ledger.read("u") is None
    ledger.append("b2", t=spark.range(0))
    assert ledger.read("t").count() == 3 and ledger.purge() == []


def test_forced_runs_are_runs_of_their_own(spark, tmp_path):
    pipeline = orchestrate.FullIngestionPipeline(spark, str(tmp_path), ingest.toy_model(), ingest.Settings("toy"))
    for force in (False, True):
        pipeline.run(prompts(spark, 2), force, day="2024-01-01")
    assert pipeline.known().select("run_id").distinct().count() == 4


def test_run_ids_of_many_keys(spark):
    ids = spark.range(371_000).select(R.unique_run_id(F.lit("2024-05-01").cast("date"), F.col("id").cast("string")).alias("id"))
    assert ids.distinct().count() == 371_000
    one = ids.select("id", R.short_run_id(F.col("id")).alias("short"), R.date_of(F.col("id")).alias("day")).first()
    assert one["id"].startswith(one["short"]) and one["short"].startswith("2024-05-01_") and len(one["short"]) == 19 and one["day"] == "2024-05-01"


def test_streams_take_a_key_with_other_settings(spark, tmp_path):
    schema = "run_key string, processing_fingerprint string, n int"
    for rows in ([("k1", "f1", 2), ("k1", "f1", 1)], [("k1", "f2", 3), ("k1", "f1", 4), ("k2", "f1", 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = streaming.source(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        streaming.append_unprocessed(events, f"{tmp_path}/runs", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert sorted(tuple(r)[:3] for r in spark.read.parquet(f"{tmp_path}/runs").collect()) == [("k1", "f1", 1), ("k1", "f2", 3), ("k2", "f1", 5)]


def test_repeated_rows_have_numbers_of_their_own(spark):
    rows = [("b", 1), ("a", 2), ("a", 2), (None, 3), ("a", 1), (None, 3)] + [("c", 9)] * 300
    found = K.numbered(spark.createDataFrame(rows, "t string, n int").repartition(5), "t").orderBy("idx").collect()
    assert [r["idx"] for r in found] == list(range(306)) and [r["t"] for r in found] == [None, None, "a", "a", "a", "b"] + ["c"] * 300
    assert sorted((r["t"] or "", r["n"]) for r in found) == sorted((t or "", n) for t, n in rows)
    assert K.numbered(spark.createDataFrame([], "t string"), "t").count() == 0


def test_chunks_of_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(B, "CHUNKS", 2)
    rows = spark.createDataFrame([(None, "abcdef"), ("p", "ab"), ("p", "abcd"), (None, None), ("q", "")], "prompt_id string, text string").withColumn("messages", F.lit(None).cast("array<struct<role:string,content:string>>"))
    found = B.chunk_evaluator(rows, lambda texts: [1 - len(t) / 10 for t in texts], chunk_chars=4, threshold=0.3).collect()
    assert sorted((r["prompt_id"] or "", round(r["pg_score"], 6), r["pg_label"]) for r in found) == [("", 0.0, 0), ("", 0.4, 1), ("p", 0.2, 0), ("p", 0.4, 1), ("q", 0.0, 0)]


def test_a_text_goes_through_the_model_once(spark):
    calls = spark.sparkContext.accumulator(0)

    class First:
        def scores(self, rows):
            return rows.withColumn("score", F.col("x")[0])

    def model(texts):
        calls.add(len(texts))
        return [{0: np.array([len(t)])} if t else ValueError("empty") for t in texts]

    rows = spark.createDataFrame([(i, "t" * (i % 7)) for i in range(100)], "id long, text string").repartition(3)
    found = inference.InferencePipeline(model, inference.RawExtractor(), First(), 3.0, chat=False).classify(rows)
    assert found.where("is_malicious").count() == 56 and found.where("score IS NULL").count() == 15
    assert calls.value == 100


def test_top_influences_are_cut_before_they_are_gathered(spark):
    found = spark.createDataFrame([(k, f, float((f * 7) % 5)) for k in ("a", "b", None) for f in range(9)], "k string, feature_idx int, contribution double")
    top = inference.ranked_influences(found, "k", 2, "positive")
    assert sorted((r["k"] or "", r["rank"], r["feature_idx"]) for r in top.collect()) == [(k, rank, f) for k in ("", "a", "b") for rank, f in ((1, 2), (2, 7))]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("first, end", [(0, 1000), (5, 6), (7, 23), (0, 0)])
def test_stretches_of_the_grid(spark, first, end):
    contexts = [(0, "a\nb\nc"), (1, "one"), (2, "\nx"), (3, None)]
    attacks = [(0, "A"), (1, "B\nB")]
    whole = K.injected(spark.createDataFrame(contexts, "idx long, context string"), spark.createDataFrame(attacks, "k long, attack_str string")).collect()
    order = sorted(whole, key=lambda r: (r["idx"], r["k"], ("start", "middle", "end").index(r["position"])))
    found = K.injected_range(spark.createDataFrame(contexts, "idx long, context string"), spark.createDataFrame(attacks, "idx long, attack_str string"), first, end).orderBy("cell").collect()
    assert [(r["idx"], r["position"], r["user_prompt"]) for r in found] == [(r["idx"], r["position"], r["user_prompt"]) for r in order[first:end]]
    assert [r["cell"] for r in found] == [*range(24)][first:end]


def test_settings_of_rows(spark):
    from tessera.operators import matrix as M
    from tessera.sources import files

    made = [ingest.Settings("toy", (2, 1), (3, 0), 100), ingest.Settings("m", (0,), ("last", 0), 5, 7), ingest.Settings("m", (10, 9), (-1, 10, 2), 5, 7)]
    rows = spark.createDataFrame([(s.model_hash, list(s.layers), [str(p) for p in s.positions], s.max_tokens, s.seed, s.fingerprint) for s in made], "model string, layers array<int>, positions array<string>, max_tokens int, seed int, expected string")
    found = rows.select(R.fingerprint(*(F.col(c) for c in rows.columns[:5])).alias("found"), "expected").collect()
    assert all(r["found"] == r["expected"] for r in found)
    names = ["HFDataset", "Dolly15kDataset", "plain", "aB", "ABCd", ""]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(files.snake_cased(F.col("n"))).collect()] == [files.snake_case(n) for n in names]
    specs = spark.createDataFrame([(["all", "1"], 4), (["3", "1", "3"], 4)], "s array<string>, n int")
    assert [r[0] for r in specs.select(M.resolved_layers(F.col("s"), F.col("n"))).collect()] == [M.resolve_layers(["all", 1], 4), M.resolve_layers([3, 1, 3], 4)]
    with pytest.raises(Exception, match="no such layer: 4"):
        spark.createDataFrame([(["4"], 4)], "s array<string>, n int").select(M.resolved_layers(F.col("s"), F.col("n"))).collect()
    assert files.benign_class({0: "attack", 2: "Safe"}) == 2
