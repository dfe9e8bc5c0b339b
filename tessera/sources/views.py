"""The engine's tables as views over a star-schema folder, with the same views as SQL for an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each document: completed where it is labelled, pending otherwise."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("run_id"), F.col("toxic").cast("long").alias("malicious"), F.col("quality").cast("long").alias("quality"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("source").alias("dataset_id"), "lang", "n_chars", "text")
    return docs.join(labels, "run_id", "left").withColumn("status", F.when(F.col("malicious").isNull(), "pending").otherwise("completed"))


RUNS = "runs AS (SELECT d.doc_id AS run_id, d.source AS dataset_id, d.lang, d.n_chars, d.text, CAST(l.toxic AS BIGINT) AS malicious, CAST(l.quality AS BIGINT) AS quality, CASE WHEN l.toxic IS NULL THEN 'pending' ELSE 'completed' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))"


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as events: run_key is the user, labels are the props."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("run_key"), "ts", F.col("event_type").alias("status"), F.col("props").alias("prompt_labels"), "value")


RUN_EVENTS = "run_events AS (SELECT event_id AS run_id, user_id AS run_key, ts, event_type AS status, props AS prompt_labels, value FROM events)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("run_id"), "label", F.posexplode("embedding").alias("p", "x")).withColumn("v", F.col("x").cast("double"))


_CELLS = "SELECT vec_id AS run_id, label, unnest(range(len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of prompts: components over 0.15, 16 to a layer."""
    cells = _cells(spark, sf_dir).where("v > 0.15")
    return cells.select("run_id", F.expr("p div 16").alias("layer"), (F.col("p") % 16).cast("long").alias("feature_idx"), "v", F.col("label").cast("long").alias("label"))


INCIDENCE = f"incidence AS (SELECT run_id, p // 16 AS layer, p % 16 AS feature_idx, v, CAST(label AS BIGINT) AS label FROM ({_CELLS}) WHERE v > 0.15)"


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activations at positions: positive components, 16 to a position."""
    cells = _cells(spark, sf_dir).where("v > 0")
    return cells.select("run_id", F.expr("p div 16").alias("position"), (F.col("p") % 16).cast("long").alias("feature_idx"), "v")


ACTS = f"acts AS (SELECT run_id, p // 16 AS position, p % 16 AS feature_idx, v FROM ({_CELLS}) WHERE v > 0)"


def xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification data: a vector, a class and one of five datasets for each run."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("run_id"), F.transform("embedding", lambda c: c.cast("double")).alias("x"), (F.col("label") < 3).cast("long").alias("y"), (F.col("vec_id") % 5).alias("dataset_id"), F.col("label").cast("long").alias("label"))


XY = "xy AS (SELECT vec_id AS run_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x, CAST(label < 3 AS BIGINT) AS y, vec_id % 5 AS dataset_id, CAST(label AS BIGINT) AS label FROM embeddings)"
#: xy in coordinate form, i from 0.
XYC = "xyc AS (SELECT run_id, y, dataset_id, label, unnest(range(len(x))) AS i, unnest(x) AS v FROM xy)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with ties and classes: events, their value in whole units."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.round(F.col("value"), 0).alias("score"), (F.col("event_type") == "error").cast("long").alias("y"), F.concat(F.lit("ds"), (F.col("user_id") % 7).cast("string")).alias("dataset_id"))


SCORES = "scores AS (SELECT event_id AS run_id, round(value, 0) AS score, CAST(event_type = 'error' AS BIGINT) AS y, 'ds' || CAST(user_id % 7 AS VARCHAR) AS dataset_id FROM events)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as prompts with an array of messages by turn."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


MESSAGES = "msgs AS (SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn, role, text) AS messages FROM conversations GROUP BY conv_id)"
