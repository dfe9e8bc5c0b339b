"""Declared schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))

#: One prompt; labels and tools are JSON objects as text.
PROMPTS = T.StructType([T.StructField("prompt_id", T.StringType(), False), T.StructField("dataset_id", T.StringType(), False), T.StructField("messages", MESSAGES), T.StructField("labels", T.StringType()), T.StructField("tools", T.StringType()), T.StructField("text", T.StringType())])

_RUN_TEXTS = ("run_id", "prompt_id", "dataset_id", "run_key", "processing_fingerprint", "model_hash", "clt_hash", "status", "timestamp", "prompt_labels", "config", "error_message", "shard_id", "worker_id", "supersedes_run_id")
#: An event of a run's history; the newest non-null value of a column holds.
RUN_EVENTS = T.StructType([T.StructField(name, T.StringType()) for name in _RUN_TEXTS] + [T.StructField("seed", T.LongType()), T.StructField("duration_ms", T.LongType()), T.StructField("event_no", T.LongType())])

ARTIFACTS = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("created_at", T.StringType())])

FEATURE = T.StructType([T.StructField("layer", T.IntegerType()), T.StructField("position", T.IntegerType()), T.StructField("feature_idx", T.IntegerType()), T.StructField("influence", T.DoubleType()), T.StructField("activation_value", T.DoubleType()), T.StructField("logit_attribution", T.DoubleType())])

GRAPHS = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("input_tokens", T.ArrayType(T.LongType())), T.StructField("logit_tokens", T.ArrayType(T.LongType())), T.StructField("logit_probabilities", T.ArrayType(T.DoubleType())), T.StructField("features", T.ArrayType(FEATURE)), T.StructField("n_layers", T.IntegerType()), T.StructField("seed", T.LongType())])

#: Sparse features in coordinate form.
INCIDENCE = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("prompt_id", T.StringType()), *FEATURE.fields, T.StructField("is_last_pos", T.BooleanType()), T.StructField("prompt_labels", T.StringType())])
ACTIVATIONS = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("layer", T.IntegerType()), T.StructField("position", T.IntegerType()), T.StructField("feature_idx", T.IntegerType()), T.StructField("activation_value", T.DoubleType())])
RAW = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("layer", T.IntegerType()), T.StructField("position", T.IntegerType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
MANIFESTS = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("prompt_id", T.StringType()), T.StructField("dataset_id", T.StringType()), T.StructField("input_text", T.StringType()), T.StructField("input_length", T.LongType()), T.StructField("labels", T.StringType()), T.StructField("d_model", T.LongType()), T.StructField("d_sae", T.LongType())])
