"""Fitted parameters on storage: arrays and settings as a small Parquet table, wherever Spark can write."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, shape array<long>, values binary"


def save_arrays(spark: SparkSession, path: str, arrays: dict[str, np.ndarray], settings: dict) -> None:
    rows = [(name, list(np.shape(array)), np.ascontiguousarray(array, "<f8").tobytes()) for name, array in arrays.items()]
    spark.createDataFrame([*rows, ("", [], json.dumps(settings).encode())], SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_arrays(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict]:
    rows = spark.read.schema(SCHEMA).parquet(path).collect()
    arrays = {row["name"]: np.frombuffer(row["values"], "<f8").reshape(row["shape"]).copy() for row in rows if row["name"]}
    return arrays, json.loads(bytes(next(row["values"] for row in rows if not row["name"])))


def top_indices(weights: np.ndarray, k: int, direction: str = "abs") -> list[int]:
    """The indices of the k largest weights (positive), the k least (negative), both one after the other, or the k
    largest magnitudes (abs); ties by index."""
    falling, rising = (np.lexsort((np.arange(len(weights)), sign * weights))[:k].tolist() for sign in (-1, 1))
    by = {"positive": falling, "negative": rising, "both": falling + rising, "abs": np.lexsort((np.arange(len(weights)), -np.abs(weights)))[:k].tolist()}
    if direction not in by:
        raise ValueError(f"no such direction: {direction}")
    return by[direction]


def coefficient_rows(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    """(i, coef) of a weight vector."""
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "i long, coef double")
