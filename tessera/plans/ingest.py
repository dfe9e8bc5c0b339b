"""Batch ingestion: prompts through a pluggable model to activations, labels and run events.

Prompts that a completed run already has are left out (unless forced), those longer than the context are recorded as
skipped, the rest go through a model function batch by batch; an error in a row becomes a failed run, not a failed job.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import registry as R


@dataclass(frozen=True)
class Settings:
    """What a run's outcome depends on, besides its prompt."""

    model: str
    layers: tuple[int, ...] = (0,)
    positions: tuple = ("last",)
    max_tokens: int = 16384
    seed: int = 42
    extra: dict = field(default_factory=dict)

    @property
    def model_hash(self) -> str:
        return hashlib.sha1(self.model.encode()).hexdigest()[:12]

    @property
    def fingerprint(self) -> str:
        """SHA-1 of the canonical JSON; positions that are all numbers count in any order."""
        positions = sorted(self.positions) if all(isinstance(p, int) for p in self.positions) else list(self.positions)
        settings = {"model": self.model_hash, "layers": sorted(self.layers), "positions": positions, "max_tokens": self.max_tokens, "seed": self.seed, **self.extra}
        return hashlib.sha1(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


#: A model takes texts and returns, for each, a dictionary of position to vector, or an exception.
Model = Callable[[list[str]], list]


def toy_model(width: int = 16, positions: tuple[int, ...] = (-1,)) -> Model:
    """A stand-in without weights: vectors from a hash of the words up to a position; texts without words are errors."""

    def run(texts: list[str]) -> list:
        out = []
        for text in texts:
            words = text.split()
            try:
                at = [p if p >= 0 else len(words) + p for p in positions]
                if any(not 0 <= p < len(words) for p in at):
                    raise ValueError("a position is outside the sequence")
                out.append({p: np.frombuffer(hashlib.sha256(" ".join(words[: p + 1]).encode()).digest() * (width // 16 + 1), np.int16)[:width] / 32768 for p in at})
            except ValueError as e:
                out.append(e)
        return out

    return run


CAPTURED = "run_id string, run_key string, prompt_id string, dataset_id string, status string, error_message string, position int, vec array<float>"


def with_keys(prompts: DataFrame, s: Settings) -> DataFrame:
    key = R.run_key(F.col("dataset_id"), F.col("prompt_id"), F.lit(s.model_hash), F.lit(""), F.lit(s.seed))
    return prompts.withColumn("run_key", key).withColumn("processing_fingerprint", F.lit(s.fingerprint))


def pending(prompts: DataFrame, runs: DataFrame, s: Settings, force: bool = False) -> DataFrame:
    keyed = with_keys(prompts, s)
    return keyed if force else R.unprocessed(keyed, runs, ["run_key", "processing_fingerprint"])


def ingest(prompts: DataFrame, runs: DataFrame, model: Model, s: Settings, day: str, force: bool = False, batch: str = "") -> tuple[DataFrame, DataFrame]:
    """(events, vectors): a terminal event for each pending prompt, and the captured vectors of completed ones.

    The two share one stored result of the model, so it runs once. Run ids are those of the key, the settings and the
    batch, so that no two runs share one, forced ones neither.
    """
    from ..sources.storage import stored

    ready = pending(prompts, runs, s, force).withColumn("content", F.coalesce("text", X.chat_template(F.col("messages"))))
    fits, over = R.within_context(ready.withColumn("n_tokens", F.size(F.split("content", r"\s+"))), "n_tokens", s.max_tokens)
    run_id = R.unique_run_id(F.lit(day).cast("date"), F.concat_ws("|", "run_key", "processing_fingerprint", F.lit(batch)))
    rows = fits.select(run_id.alias("run_id"), "run_key", "prompt_id", "dataset_id", "content")

    def capture(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row, found in zip(frame.itertuples(index=False), model(frame["content"].tolist())):
                base = (row.run_id, row.run_key, row.prompt_id, row.dataset_id)
                out += [(*base, "failed", str(found), None, None)] if isinstance(found, Exception) else [(*base, "completed", None, p, v.tolist()) for p, v in found.items()]
            yield pd.DataFrame(out, columns=[part.split()[0] for part in CAPTURED.split(", ")])

    captured = stored(rows.mapInPandas(capture, CAPTURED))
    done = captured.groupBy("run_id", "run_key", "prompt_id", "dataset_id").agg(F.max("status").alias("status"), F.max("error_message").alias("error_message"))
    skipped = over.select(run_id.alias("run_id"), "run_key", "prompt_id", "dataset_id", F.lit("skipped").alias("status"), F.lit("longer than the context").alias("error_message"))
    events = done.unionByName(skipped).withColumn("processing_fingerprint", F.lit(s.fingerprint)).withColumn("model_hash", F.lit(s.model_hash)).withColumn("seed", F.lit(s.seed).cast("long"))
    return events, captured.where("status = 'completed'").select("run_id", F.col("position"), "vec")


def label(prompts: DataFrame, evaluate: Callable[[list[str]], list[dict]]) -> DataFrame:
    """Prompts with their labels merged with those that an evaluator returns for their texts; the evaluator's keys win."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(found) for found in evaluate(texts.tolist())])

    content = F.coalesce("text", X.flattened(F.col("messages")))
    return prompts.withColumn("_found", run(content)).withColumn("labels", F.to_json(R.merged_labels(F.col("labels"), F.col("_found")))).drop("_found")
