"""What others plug in: evaluators, extractors, interpreters and analyzers, with deterministic stand-ins.

The pre- and post-processing around a model call is column expressions; the call itself is a function over batches.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Texts to answers, batch by batch.
Call = Callable[[list[str]], list[str]]
#: Texts to probabilities of being benign.
Classify = Callable[[list[str]], list[float]]


class Analyzer(Protocol):
    def run(self, *tables: DataFrame) -> DataFrame: ...


class Interpreter(Protocol):
    """Feature ids to a table (layer, feature_idx, description)."""

    def interpret(self, features: DataFrame) -> DataFrame: ...


class ThresholdStrategy(Protocol):
    """Scored rows to a one-row table (threshold)."""

    def select(self, scored: DataFrame) -> DataFrame: ...


def called(texts: Column, call: Call) -> Column:
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(call(batch.fillna("").tolist()))

    return run(texts)


def guard_evaluator(prompts: DataFrame, call: Call, answer: str | None = None) -> DataFrame:
    """lg_label and lg_categories by a guard model that reads the rendered chat."""
    chat = X.chat_template(X.guard_chat(F.col("messages"), F.col(answer) if answer else None))
    out = prompts.withColumn("lg_raw", called(chat, call))
    return out.withColumn("lg_label", X.guard_verdict(F.col("lg_raw"))).withColumn("lg_categories", X.guard_categories(F.col("lg_raw")))


def judge_evaluator(prompts: DataFrame, call: Call) -> DataFrame:
    """lj_label and lj_raw by a judge that reads the rendered messages."""
    out = prompts.withColumn("lj_raw", called(X.rendered(F.col("messages")), call))
    return out.withColumn("lj_label", X.judge_verdict(F.col("lj_raw")))


#: Chunks that a classifier gets at once.
CHUNKS = 1024


def chunk_evaluator(prompts: DataFrame, classify: Classify, chunk_chars: int = 2000, threshold: float = 0.5) -> DataFrame:
    """pg_score, the largest chance that a chunk isn't benign, and pg_label; a row's chunks are scored together with those of
    the rows around it, at most CHUNKS at once. Rows need no id, and repeated ones are rows of their own.

    The session is set to hand at most CHUNKS rows to Python at once, and only the chunks of one call become objects there.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(prompts.sparkSession.conf.get(key))
    prompts.sparkSession.conf.set(key, min(rows, CHUNKS) if rows > 0 else CHUNKS)
    content = F.coalesce("text", X.flattened(F.col("messages")))
    scored = F.arrow_udf(lambda batch: worst_of(batch, classify), "double")(X.chunks(content, chunk_chars))
    return prompts.withColumn("pg_score", scored).withColumn("pg_label", (F.col("pg_score") >= threshold).cast("int"))


def worst_of(lists: pa.Array, classify: Classify) -> pa.Array:
    """For each list of chunks the largest chance that one isn't benign; a list without chunks counts as an empty one."""
    if not len(lists):
        return pa.array([], pa.float64())
    lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    each = np.maximum(lengths, 1)
    known, flat = np.repeat(lengths > 0, each), lists.flatten()
    at = np.cumsum(known) - 1
    benign: list[float] = []
    for start in range(0, len(at), CHUNKS):
        part = slice(start, start + CHUNKS)
        benign.extend(classify(flat.take(pa.array(at[part], mask=~known[part])).fill_null("").to_pylist()))
    return pa.array(1 - np.minimum.reduceat(np.asarray(benign, float), np.cumsum(each) - each))


#: (output, target tool, attacker's tools, user's tool, attacker's instruction) to a verdict, for one answer.
Judge = Callable[[str, str, list[str], str, str], dict]


def tool_injection_evaluator(prompts: DataFrame, judge: Judge, answer: str = "generated") -> DataFrame:
    """prompts with `injection`, the verdict on the answer as a JSON object, tool schemas that it echoes taken out first.

    Null without an answer or attacker's tools, or where the judge raises an error. labels is the prompt's JSON object.
    """
    schema = "attacker_tools array<string>, user_tool string, attacker_instruction string"
    of = F.from_json(F.coalesce("labels", F.lit("{}")), schema)

    @F.pandas_udf("string")
    def verdict(outputs: pd.Series, labels: pd.DataFrame) -> pd.Series:
        def one(output: str | None, tools: list | None, user_tool: str | None, instruction: str | None) -> str | None:
            if output is None or tools is None or not len(tools):
                return None
            try:
                return json.dumps(judge(output, tools[0], list(tools), user_tool or "", instruction or ""))
            except Exception:  # the judge is another's code: an error is no verdict
                return None

        return pd.Series([one(*each) for each in zip(outputs, labels["attacker_tools"], labels["user_tool"], labels["attacker_instruction"])], dtype=object)

    return prompts.withColumn("injection", verdict(X.without_tools(F.col(answer)), of))


def sparse_encode(vectors: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(run_id, position, feature_idx, v): relu(x W + b), non-zero features only; weights d x features, shipped once to a worker."""
    shared = vectors.sparkSession.sparkContext.broadcast((weights, bias))
    keep = vectors.select("run_id", "position", "vec")

    def encode(frames):
        w, b = shared.value
        for frame in frames:
            x = np.maximum(np.array(frame["vec"].tolist(), float).reshape(len(frame), -1) @ w + b, 0)
            row, feature = np.nonzero(x)
            yield pd.DataFrame({"run_id": frame["run_id"].to_numpy()[row], "position": frame["position"].to_numpy()[row], "feature_idx": feature, "v": x[row, feature]})

    kind = dict(keep.dtypes)
    return keep.mapInPandas(encode, f"run_id {kind['run_id']}, position {kind['position']}, feature_idx int, v double")


class TableInterpreter:
    """Descriptions from a table (layer, feature_idx, explanations, activations): the first explanation, ten activations."""

    def __init__(self, known: DataFrame):
        self.known = known

    def interpret(self, features: DataFrame) -> DataFrame:
        found = features.join(self.known, ["layer", "feature_idx"], "left")
        return found.select(*features.columns, F.element_at("explanations", 1).alias("description"), F.slice("activations", 1, 10).alias("activations"), F.when(F.col("explanations").isNotNull(), "table").alias("source"))


class RemoteInterpreter:
    """Descriptions fetched feature by feature from a service, kept in a table, at a bounded rate.

    fetch(layer, feature_idx) returns explanations and activations, or None; each of `tasks` tasks calls it at most
    per_second / tasks times a second. What the table has isn't fetched again, also that there is nothing.
    """

    SCHEMA = "layer int, feature_idx int, explanations array<string>, activations array<double>"

    def __init__(self, fetch: Callable[[int, int], tuple[list[str], list[float]] | None], cache_path: str, per_second: float = 2.0, tasks: int = 1):
        self.fetch, self.cache_path, self.per_second, self.tasks = fetch, cache_path, per_second, tasks

    def interpret(self, features: DataFrame) -> DataFrame:
        from ..sources.storage import exists

        spark = features.sparkSession
        wanted = features.select(F.col("layer").cast("int"), F.col("feature_idx").cast("int")).distinct()
        if exists(spark, self.cache_path):
            wanted = wanted.join(spark.read.schema(self.SCHEMA).parquet(self.cache_path), ["layer", "feature_idx"], "left_anti")
        fetch, pause = self.fetch, self.tasks / self.per_second

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            due = 0.0
            for frame in frames:
                out = []
                for layer, feature in zip(frame["layer"], frame["feature_idx"]):
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + pause
                    found = fetch(int(layer), int(feature))
                    out.append((layer, feature, *(found or (None, None))))
                yield pd.DataFrame(out, columns=["layer", "feature_idx", "explanations", "activations"])

        wanted.repartition(self.tasks).mapInPandas(run, self.SCHEMA).write.mode("append").parquet(self.cache_path)
        known = spark.read.schema(self.SCHEMA).parquet(self.cache_path).where("explanations IS NOT NULL")
        return TableInterpreter(known).interpret(features)


class ModelInterpreter:
    """Descriptions by a language model, from the texts in which a feature is largest: contexts (layer, feature_idx, text, v)."""

    def __init__(self, call: Call, contexts: DataFrame, examples: int = 5):
        self.call, self.contexts, self.examples = call, contexts, examples

    def interpret(self, features: DataFrame) -> DataFrame:
        largest = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("by"), "text"))), 1, self.examples)
        own = self.contexts.join(features.select("layer", "feature_idx").distinct(), ["layer", "feature_idx"])
        ranked = own.withColumn("_k", F.row_number().over(Window.partitionBy("layer", "feature_idx").orderBy(F.desc("v"), "text"))).where(F.col("_k") <= self.examples)
        asked = ranked.groupBy("layer", "feature_idx").agg(F.concat_ws("\n", F.lit("What do these texts share?"), F.transform(largest, lambda e: e["text"])).alias("question"))
        answers = asked.withColumn("description", called(F.col("question"), self.call)).drop("question")
        return features.join(answers, ["layer", "feature_idx"], "left").withColumn("source", F.when(F.col("description").isNotNull(), "model"))


#: Evaluators by their configured names: functions of prompts and of what they ask.
EVALUATORS: dict[str, Callable] = {"llama_guard": guard_evaluator, "llama_judge": judge_evaluator, "prompt_guard": chunk_evaluator, "injecagent": tool_injection_evaluator}


def evaluator(name: str, *asked: Callable, **settings: object) -> Callable[[DataFrame], DataFrame]:
    """An evaluator by its configured name, with or without Evaluator behind, or of another module as "module:name"."""
    from ..sources import files

    made = files.construct(name, {known: (lambda f=f: f) for known, f in EVALUATORS.items()}, "_evaluator") if ":" not in name else files.construct(name, {})
    return lambda prompts: made(prompts, *asked, **settings)
