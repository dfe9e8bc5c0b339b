"""Ingestion over a configuration: every configured dataset in one job, with limits, shards, counters and a dry run.

Runs are events appended to a table; what a completed run of the same key and settings has is left out, so that a
repeated call does only the rest. Datasets go through one plan, not one process each: Spark schedules them together.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry as R
from ..sources import converters as K
from ..sources import files, storage
from ..sources.ledger import Ledger
from . import ingest as I

#: A dataset's raw rows by its name, numbered by idx.
Load = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Shard:
    index: int = 0
    of: int = 1

    def __post_init__(self):
        if not 0 <= self.index < self.of:
            raise ValueError(f"no shard {self.index} of {self.of}")


def prompts(config: dict, load: Load, num_prompts: int | None = None, shard: Shard = Shard(), only: list[str] | None = None) -> DataFrame:
    """The prompts of all configured datasets, each with its limit: the call's, the dataset's or the configuration's."""
    parts = []
    for name, own in (config.get("datasets") or {}).items():
        own = own or {}
        if own.get("enabled", True) and (only is None or name in only):
            raw = K.shard(load(name), shard.index, shard.of)
            made = files.converter(own.get("converter", name), **(own.get("settings") or {})).convert(raw)
            limit = files.prompt_limit(num_prompts, own.get("num_prompts"), config.get("num_prompts"))
            parts.append(made.orderBy("prompt_id").limit(limit) if limit != -1 else made)
    if not parts:
        raise ValueError("no dataset is enabled")
    return K.union_all(parts)


class FullIngestionPipeline:
    """Prompts through a model: vectors and run events are appended below a root folder, both or neither of a call."""

    def __init__(self, spark: SparkSession, root: str, model: I.Model, settings: I.Settings):
        self.spark, self.model, self.settings, self.ledger = spark, model, settings, Ledger(spark, root)

    def known(self) -> DataFrame:
        """The events so far."""
        events = self.ledger.read("events")
        return events if events is not None else self.spark.createDataFrame([], "run_key string, processing_fingerprint string, status string")

    def vectors(self) -> DataFrame:
        """The vectors so far."""
        vectors = self.ledger.read("vectors")
        return vectors if vectors is not None else self.spark.createDataFrame([], "run_id string, position int, vec array<float>, batch_id string")

    def plan(self, rows: DataFrame, force: bool = False) -> DataFrame:
        """(dataset_id, n, pending): what a run would do."""
        waiting = I.pending(rows, self.known(), self.settings, force).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("pending"))
        return rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).join(waiting, "dataset_id", "left").fillna(0, ["pending"])

    def run(self, rows: DataFrame, force: bool = False, day: str | None = None) -> DataFrame:
        """(dataset_id, status, n): the counters of this call."""
        day = day or datetime.datetime.now(datetime.timezone.utc).date().isoformat()
        batch = self.ledger.new_batch()
        events, vectors = I.ingest(rows, self.known(), self.model, self.settings, day, force, batch)
        events = storage.stored(events)
        self.ledger.append(batch, vectors=vectors, events=events)
        return events.groupBy("dataset_id", "status").agg(F.count(F.lit(1)).alias("n"))


class LabelsOnlyIngestionPipeline:
    """Prompts through evaluators only: labels are appended as events, without vectors."""

    def __init__(self, spark: SparkSession, root: str, evaluate: Callable[[list[str]], list[dict]], settings: I.Settings):
        self.spark, self.evaluate, self.settings, self.ledger = spark, evaluate, settings, Ledger(spark, root)

    def run(self, rows: DataFrame, force: bool = False) -> DataFrame:
        """(dataset_id, n): how many prompts were labelled."""
        keyed, known = I.with_keys(rows, self.settings), self.ledger.read("labels")
        if not force and known is not None:
            keyed = R.unprocessed(keyed, known.withColumn("status", F.lit("completed")), ["run_key", "processing_fingerprint"])
        labelled = storage.stored(I.label(keyed, self.evaluate).select("run_key", "processing_fingerprint", "prompt_id", "dataset_id", "labels"))
        self.ledger.append(self.ledger.new_batch(), labels=labelled)
        return labelled.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
