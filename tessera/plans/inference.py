"""From prompts to scores: an extractor turns a model's vectors into features, a classifier scores them.

A model is a function from texts to, for each, a dictionary of position to vector, or an exception (see ingest.Model);
prompts go through it batch by batch, one result a row. A prompt whose model call fails has null features and scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.classify import Classifier
from ..sources.storage import stored
from .ingest import Model


class Extractor(Protocol):
    """A prompt's vectors by position to one feature vector."""

    def features(self, vectors: dict[int, np.ndarray]) -> np.ndarray: ...


def reduced(vectors: dict[int, np.ndarray], position: str | int | list[int]) -> np.ndarray:
    """last, mean or max over positions; one position, negative ones from the end; several, one after the other."""
    places = sorted(vectors)
    stack = np.array([vectors[p] for p in places], float)
    if position == "mean":
        return stack.mean(axis=0)
    if position == "max":
        return stack.max(axis=0)
    wanted = [-1] if position == "last" else [position] if isinstance(position, int) else list(position)
    if any(not -len(places) <= p < len(places) for p in wanted):
        raise ValueError(f"a position of {wanted} is outside {len(places)}")
    return np.concatenate([stack[p] for p in wanted])


class RawExtractor:
    """The model's own vectors."""

    def __init__(self, position: str | int | list[int] = "last"):
        self.position = position

    def features(self, vectors: dict[int, np.ndarray]) -> np.ndarray:
        return reduced(vectors, self.position)


class SparseExtractor:
    """Features of an encoder, relu(x W + b), at each position, then reduced; few are not zero."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, position: str | int | list[int] = "last"):
        self.weights, self.bias, self.position = weights, bias, position

    def features(self, vectors: dict[int, np.ndarray]) -> np.ndarray:
        encoded = {place: np.maximum(np.asarray(vector, float) @ self.weights + self.bias, 0) for place, vector in vectors.items()}
        return reduced(encoded, self.position)


def extracted(prompts: DataFrame, model: Model, extractor: Extractor, chat: bool = True, column: str = "text") -> DataFrame:
    """prompts with `x`, the features of the text, as a user's message if chat; null where the model or extractor fails."""
    as_chat = X.chat_template(F.array(F.struct(F.lit("user").alias("role"), F.coalesce(F.col(column), F.lit("")).alias("content"))))

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(found: object) -> list[float] | None:
            try:
                return None if isinstance(found, Exception) else extractor.features(found).tolist()
            except ValueError:
                return None

        for texts in batches:
            yield pd.Series([one(found) for found in model(texts.tolist())])

    return prompts.withColumn("x", features(as_chat if chat else F.coalesce(F.col(column), F.lit(""))))


class InferencePipeline:
    """A model, an extractor, a fitted classifier and a threshold."""

    def __init__(self, model: Model, extractor: Extractor, classifier: Classifier, threshold: float = 0.5, chat: bool = True):
        self.model, self.extractor, self.classifier, self.threshold, self.chat = model, extractor, classifier, threshold, chat

    def classify(self, prompts: DataFrame, column: str = "text") -> DataFrame:
        """prompts with score, prediction, is_malicious and features; null for a prompt without features.

        The features are stored, so that every text goes through the model once.
        """
        rows = stored(extracted(prompts, self.model, self.extractor, self.chat, column))
        scored = self.classifier.scores(rows.where("x IS NOT NULL"))
        without = rows.where("x IS NULL").withColumn("score", F.lit(None).cast("double"))
        both = scored.unionByName(without.select(scored.columns))
        flag = F.col("score") >= self.threshold
        return both.withColumn("prediction", flag.cast("int")).withColumn("is_malicious", flag).withColumnRenamed("x", "features")


def top_influences(results: DataFrame, weights: np.ndarray, k: int, direction: str = "positive", key: str = "prompt_id", vector: str = "features") -> DataFrame:
    """(key, feature_idx, coefficient, activation, contribution, rank) of each row's k features by coefficient times
    activation: the largest, the least (negative), or the largest magnitudes (abs); ties by index."""
    if direction not in ("positive", "negative", "abs"):
        raise ValueError(f"no such direction: {direction}")
    cells = results.select(key, F.posexplode(vector).alias("feature_idx", "activation"))
    coefficients = results.sparkSession.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "feature_idx int, coefficient double")
    found = cells.join(F.broadcast(coefficients), "feature_idx").withColumn("contribution", F.col("activation") * F.col("coefficient"))
    return ranked_influences(found, key, k, direction)


def ranked_influences(found: DataFrame, key: str, k: int, direction: str) -> DataFrame:
    """The first k (key, feature_idx, contribution, ...) of each key with their rank from 1: only k rows a key leave a task."""
    value = {"positive": -F.col("contribution"), "negative": F.col("contribution"), "abs": -F.abs("contribution")}[direction]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(value, "feature_idx"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(key, *(c for c in found.columns if c != key), "rank")
