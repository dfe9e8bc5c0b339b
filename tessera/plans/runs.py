"""Queries over the run registry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import registry as R
from ..sources import views as V
from ..sources.storage import shared_folder
from ..streaming import state
from .catalog import query

E_ = f"WITH {V.RUN_EVENTS} "
R_ = f"WITH {V.RUNS} "
LATEST = "SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY ts DESC, run_id DESC) AS k FROM "


@query("FLT1_get_runs", R_ + "SELECT run_id, dataset_id, status FROM runs WHERE dataset_id = 'src3' AND status = 'completed'")
def get_runs(spark, d):
    return R.get_runs(V.runs(spark, d), "src3", "completed").select("run_id", "dataset_id", "status")


@query("FLT2_label_strict", E_ + "SELECT run_id FROM run_events WHERE json_extract_string(prompt_labels, '$.k') = '6'")
def label_strict(spark, d):
    return V.run_events(spark, d).where(R.label_filter(F.col("prompt_labels"), "k", "6")).select("run_id")


@query("FLT2_label_like", E_ + """SELECT run_id FROM run_events WHERE prompt_labels ILIKE '%"k": 6%'""")
def label_like(spark, d):
    return V.run_events(spark, d).where(R.label_like(F.col("prompt_labels"), "k", "6")).select("run_id")


@query("FLT3_exists", E_ + "SELECT DISTINCT user_id AS run_key FROM events WHERE EXISTS (SELECT 1 FROM run_events r WHERE r.run_key = user_id AND r.status = 'error')")
def exists(spark, d):
    e = V.run_events(spark, d)
    return R.exists(e.where("status = 'error'"), e.select("run_key").distinct(), ["run_key"])


@query("FLT4_unprocessed", R_ + "SELECT run_id, dataset_id FROM runs WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'completed')")
def unprocessed(spark, d):
    r = V.runs(spark, d)
    return R.unprocessed(r.select("run_id", "dataset_id"), r.select("run_id", "status"), ["run_id"])


@query("FLT5_context_limit", R_ + "SELECT dataset_id, count(*) FILTER (n_chars <= 2000) AS kept, count(*) FILTER (n_chars > 2000) AS skipped FROM runs GROUP BY dataset_id")
def context_limit(spark, d):
    fits, over = R.within_context(V.runs(spark, d).select("dataset_id", "n_chars"), "n_chars", 2000)
    both = fits.withColumn("fit", F.lit(1)).unionByName(over.withColumn("fit", F.lit(0)))
    return both.groupBy("dataset_id").agg(F.count(F.when(F.col("fit") == 1, 1)).alias("kept"), F.count(F.when(F.col("fit") == 0, 1)).alias("skipped"))


@query("FLT11_load_labels", E_ + "SELECT run_id, json_extract_string(prompt_labels, '$.k') AS k, json_extract_string(prompt_labels, '$.absent') AS absent FROM run_events")
def load_labels(spark, d):
    return R.load_labels(V.run_events(spark, d), ["k", "absent"])


@query("FLT12_run_ids", R_ + "SELECT run_id FROM runs WHERE status = 'completed'")
def run_ids(spark, d):
    return R.get_runs(V.runs(spark, d), status="completed").select("run_id")


@query("FLT15_labelled_only", R_ + "SELECT run_id, malicious AS y FROM runs WHERE malicious IS NOT NULL")
def labelled_only(spark, d):
    return V.runs(spark, d).where(F.col("malicious").isNotNull()).select("run_id", F.col("malicious").alias("y"))


@query("WN1_latest_per_key", E_ + f"SELECT run_key, run_id, status FROM ({LATEST} run_events) WHERE k = 1")
def latest_per_key(spark, d):
    return R.latest_by(V.run_events(spark, d), ["run_key"], "ts").select("run_key", "run_id", "status")


@query("WN1_latest_after_limit", E_ + f"SELECT run_key, run_id FROM ({LATEST} (SELECT * FROM run_events ORDER BY ts DESC, run_id DESC LIMIT 200)) WHERE k = 1")
def latest_after_limit(spark, d):
    return R.get_runs(V.run_events(spark, d), latest_only=True, limit=200, order="ts").select("run_key", "run_id")


@query("WN1_latest_before_limit", E_ + f"SELECT run_key, run_id FROM ({LATEST} run_events) WHERE k = 1 ORDER BY ts DESC, run_id DESC LIMIT 50")
def latest_before_limit(spark, d):
    return R.get_runs(V.run_events(spark, d), latest_only=True, limit=50, order="ts", dedupe_first=True).select("run_key", "run_id")


@query("WN2_latest_by_key_status", E_ + "SELECT run_key, status, max_by(run_id, (ts, run_id)) AS run_id FROM run_events GROUP BY run_key, status")
def latest_by_two(spark, d):
    return R.latest_by(V.run_events(spark, d), ["run_key", "status"], "ts").select("run_key", "status", "run_id")


@query("WN9_version_history", E_ + "SELECT run_id, lag(run_id) OVER w AS supersedes_run_id, row_number() OVER w AS version FROM run_events WINDOW w AS (PARTITION BY run_key ORDER BY ts, run_id)")
def version_history(spark, d):
    return R.version_history(V.run_events(spark, d), "ts").select("run_id", "supersedes_run_id", "version")


@query("TK9_newest_runs", E_ + "SELECT run_id, run_key FROM run_events ORDER BY ts DESC, run_id DESC LIMIT 25")
def newest(spark, d):
    return R.get_runs(V.run_events(spark, d), limit=25, order="ts").select("run_id", "run_key")


@query("TK12_random_sample", E_ + "SELECT run_id FROM run_events ORDER BY md5(CAST(run_id AS VARCHAR) || '|42'), run_id LIMIT 100")
def random_sample(spark, d):
    return R.sample_completed(V.run_events(spark, d).withColumn("status", F.lit("completed")), 100).select("run_id")


@query("SRC17_random_completed", R_ + "SELECT run_id FROM runs WHERE status = 'completed' AND dataset_id = 'src1' ORDER BY md5(CAST(run_id AS VARCHAR) || '|42'), run_id LIMIT 1")
def random_completed(spark, d):
    return R.sample_completed(V.runs(spark, d).where("dataset_id = 'src1'"), 1).select("run_id")


@query("AG1_statistics", R_ + "SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(dataset_id) = 0 THEN 'dataset' ELSE 'total' END AS what, coalesce(status, dataset_id) AS value, count(*) AS n FROM runs GROUP BY GROUPING SETS ((status), (dataset_id), ())")
def statistics(spark, d):
    return R.statistics(V.runs(spark, d))


def _artifacts(spark, d):
    e = V.table(spark, d, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("path"), (F.col("event_id") * 1000).alias("size_bytes"), F.col("ts").alias("created_at"))


A_ = "WITH a AS (SELECT user_id AS run_id, event_type AS kind, event_id AS path, event_id * 1000 AS size_bytes, ts AS created_at FROM events) "


@query("AG2_storage_gb", A_ + "SELECT round(coalesce(sum(size_bytes), 0) / pow(1024, 3), 9) AS gb FROM a")
def storage_gb(spark, d):
    return R.storage_gb(_artifacts(spark, d)).select(F.round("gb", 9).alias("gb"))


@query("SNK5_latest_artifacts", A_ + "SELECT run_id, kind, path, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY created_at DESC, path DESC) AS k FROM a) WHERE k = 1")
def latest_artifacts(spark, d):
    return R.latest_artifacts(_artifacts(spark, d)).select("run_id", "kind", "path", "size_bytes")


@query("SRC19_get_artifacts", A_ + "SELECT kind, max_by(path, (created_at, path)) AS path FROM a WHERE run_id = 7 GROUP BY kind")
def get_artifacts(spark, d):
    return R.latest_artifacts(_artifacts(spark, d).where("run_id = 7")).select("kind", "path")


def _history(spark, d):
    """Three events of each run: created, its status, and, for some, its labels."""
    e = V.run_events(spark, d)
    created = e.select("run_id", F.lit(1).cast("long").alias("event_no"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("labels"))
    moved = e.select("run_id", F.lit(2).cast("long").alias("event_no"), F.when(F.col("status") == "error", "failed").otherwise("completed").alias("status"), F.col("prompt_labels").alias("labels"))
    relabelled = e.where("run_id % 3 = 0").select("run_id", F.lit(3).cast("long").alias("event_no"), F.lit(None).cast("string").alias("status"), F.lit('{"k": 0}').alias("labels"))
    return created.unionByName(moved).unionByName(relabelled)


H_ = E_ + "SELECT run_id, CASE WHEN status = 'error' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN run_id % 3 = 0 THEN '{\"k\": 0}' ELSE prompt_labels END AS labels FROM run_events"


@query("SNK2_SNK3_SNK4_current_state", H_)
def current_state(spark, d):
    return R.current(_history(spark, d))


@query("SNK1_create_runs", R_ + "SELECT run_id, sha1(dataset_id || '|' || CAST(run_id AS VARCHAR) || '|m|c|42') AS run_key, 'pending' AS status FROM runs")
def create_runs(spark, d):
    key = R.run_key(F.col("dataset_id"), F.col("run_id"), F.lit("m"), F.lit("c"), F.lit(42))
    return V.runs(spark, d).select("run_id", key.alias("run_key"), R.checked_status(F.lit("pending")).alias("status"))


@query("SNK13_delete_runs", f"WITH {V.INCIDENCE} SELECT run_id, count(*) AS n FROM incidence WHERE run_id % 10 <> 3 GROUP BY run_id")
def delete_runs(spark, d):
    i = V.incidence(spark, d)
    return R.without_runs(i, i.where("run_id % 10 = 3").select("run_id").distinct()).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("SC12_merged_labels", E_ + "SELECT run_id, json_extract_string(prompt_labels, '$.k') AS a, '1' AS b, CASE WHEN run_id % 2 = 0 THEN 'new' ELSE json_extract_string(prompt_labels, '$.k') END AS k FROM run_events")
def merged(spark, d):
    e = V.run_events(spark, d)
    m = R.merged_labels(F.col("prompt_labels"), F.when(F.col("run_id") % 2 == 0, F.lit('{"b": 1, "k": "new"}')).otherwise(F.lit('{"b": 1}')))
    return e.select("run_id", F.get_json_object("prompt_labels", "$.k").alias("a"), m["b"].alias("b"), m["k"].alias("k"))


@query("SC15_run_date", R_ + "SELECT run_id, strftime(DATE '2024-01-01' + CAST(run_id % 366 AS INTEGER), '%Y-%m-%d') AS day FROM runs")
def run_date(spark, d):
    r = V.runs(spark, d).select("run_id", R.run_id(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("run_id") % 366).cast("int")), F.col("run_id").cast("string")).alias("id"))
    return r.select("run_id", R.date_of(F.col("id")).alias("day"))


@query("SC22_run_ids_made", R_ + "SELECT run_id, '2024-05-01_' || substr(sha1(CAST(run_id AS VARCHAR)), 1, 8) AS id FROM runs")
def made_ids(spark, d):
    return V.runs(spark, d).select("run_id", R.run_id(F.lit("2024-05-01").cast("date"), F.col("run_id").cast("string")).alias("id"))


@query("SRC15_list_runs", E_ + "SELECT DISTINCT CAST(ts AS DATE) AS day, run_key FROM run_events WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM run_events) ORDER BY run_key")
def list_runs(spark, d):
    e = V.run_events(spark, d).select(F.to_date("ts").alias("day"), "run_key")
    first = e.agg(F.min("day").alias("day"))
    return e.join(F.broadcast(first), "day").select("day", "run_key").distinct()


@query("AG26_ingestion_counters", R_ + "SELECT dataset_id, count(*) FILTER (status = 'completed') AS success, count(*) FILTER (status = 'pending') AS skipped, count(*) AS n FROM runs GROUP BY dataset_id")
def counters(spark, d):
    return V.runs(spark, d).groupBy("dataset_id").agg(F.count(F.when(F.col("status") == "completed", 1)).alias("success"), F.count(F.when(F.col("status") == "pending", 1)).alias("skipped"), F.count(F.lit(1)).alias("n"))


@query("AG27_label_distribution", R_ + "SELECT malicious, count(*) AS n FROM runs GROUP BY malicious")
def label_distribution(spark, d):
    return V.runs(spark, d).groupBy("malicious").agg(F.count(F.lit(1)).alias("n"))


@query("AG27_label_coverage", R_ + "SELECT dataset_id, round(count(malicious) / count(*), 6) AS coverage FROM runs GROUP BY dataset_id")
def label_coverage(spark, d):
    return V.runs(spark, d).groupBy("dataset_id").agg(F.round(F.count("malicious") / F.count(F.lit(1)), 6).alias("coverage"))


@query("AG20_timing", "SELECT event_type AS timer, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(value), 6) AS max, count(*) AS n FROM events GROUP BY event_type")
def timing(spark, d):
    e = V.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("timer")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.max("value"), 6).alias("max"), F.count(F.lit(1)).alias("n"))


@query("PRJ5_row_to_dict", E_ + "SELECT run_id, CAST(json_extract_string(prompt_labels, '$.k') AS BIGINT) AS k FROM run_events")
def row_to_dict(spark, d):
    return V.run_events(spark, d).select("run_id", F.from_json("prompt_labels", "k long")["k"].alias("k"))


@query("SRC13_point_read", E_ + "SELECT run_id, run_key, status FROM run_events WHERE run_id BETWEEN 100 AND 120")
def point_read(spark, d):
    return V.run_events(spark, d).where(F.col("run_id").between(100, 120)).select("run_id", "run_key", "status")


@query("JN4_rows_with_metadata", f"WITH {V.RUNS}, {V.INCIDENCE} SELECT i.run_id, r.dataset_id, count(*) AS n FROM incidence i JOIN runs r ON i.run_id = r.run_id GROUP BY i.run_id, r.dataset_id")
def rows_with_metadata(spark, d):
    return V.incidence(spark, d).join(V.runs(spark, d).select("run_id", "dataset_id"), "run_id").groupBy("run_id", "dataset_id").agg(F.count(F.lit(1)).alias("n"))


@query("SRC14_prompts_of_runs", R_ + "SELECT r.run_id, coalesce(b.text, '') AS prompt FROM (SELECT run_id FROM runs) r LEFT JOIN benchmark b ON b.item_id = r.run_id")
def prompts_of_runs(spark, d):
    manifests = V.table(spark, d, "benchmark").select(F.col("item_id").alias("run_id"), F.col("text").alias("input_text"))
    return V.runs(spark, d).select("run_id").join(manifests, "run_id", "left").select("run_id", F.coalesce("input_text", F.lit("")).alias("prompt"))


@query("SNK2_SNK5_streamed_state", "SELECT user_id AS run_key, arg_max(event_type, event_id) FILTER (event_type IS NOT NULL) AS status, round(arg_max(value, event_id) FILTER (value > 50), 6) AS value FROM events GROUP BY user_id")
def streamed_state(spark, d):
    """Each user's newest status and newest value over 50, kept up by a stream of all events."""
    events = V.table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = stream.select(F.col("user_id").alias("run_key"), F.col("event_id").alias("event_no"), F.col("event_type").alias("status"), F.when(F.col("value") > 50, F.col("value")).alias("value"))
    path, before = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}", spark.conf.get(state.STORE)
    try:
        states = state.newest_values(rows, "run_key")
        query = states.writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(state.STORE, before)
    return state.current_of(spark.read.schema(states.schema).parquet(f"{path}/out"), "run_key").withColumn("value", F.round("value", 6))
