"""The run registry: an append-only history of events, read through latest-per-key views.

Plain Parquet has no UPDATE, so each change of a run is an event, and a view takes the newest value of every column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of a run.
STATUSES = ("pending", "running", "completed", "failed", "skipped")


def run_key(*parts: Column) -> Column:
    """SHA-1 in hex of the parts joined by "|"; nulls count as empty."""
    return F.sha1(F.array_join(F.transform(F.array(*[p.cast("string") for p in parts]), lambda p: F.coalesce(p, F.lit(""))), "|"))


def fingerprint(model_hash: Column, layers: Column, positions: Column, max_tokens: Column, seed: Column) -> Column:
    """The fingerprint of each row's settings, as ingest.Settings has it: SHA-1 of their canonical JSON, 16 digits. positions
    are texts, numbers or names; if all are numbers, they count in any order."""
    number = lambda p: p.rlike("^-?[0-9]+$")
    joined = lambda items: F.array_join(items.cast("array<string>"), ", ")
    named = joined(F.transform(positions, lambda p: F.when(number(p), p).otherwise(F.concat(F.lit('"'), p, F.lit('"')))))
    places = F.when(F.forall(positions, number), joined(F.array_sort(F.transform(positions, lambda p: p.try_cast("bigint"))))).otherwise(named)
    parts = [F.lit('{"layers": ['), joined(F.array_sort(layers)), F.lit('], "max_tokens": '), max_tokens.cast("string"), F.lit(', "model": "'), model_hash, F.lit('", "positions": ['), places, F.lit('], "seed": '), seed.cast("string"), F.lit("}")]
    return F.substring(F.sha1(F.concat(*parts)), 1, 16)


def run_id(day: Column, key: Column) -> Column:
    """Date and eight hex digits; a hash of the key rather than random digits, so that a retried task writes the same."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("_"), F.substring(F.sha1(key), 1, 8))


def unique_run_id(day: Column, key: Column) -> Column:
    """The run id of that day and key with 24 more digits of the hash: none are equal among any number of keys."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("_"), F.substring(F.sha1(key), 1, 32))


def short_run_id(run: Column) -> Column:
    """A run id as it is shown: the date and eight digits."""
    return F.substring(run, 1, 19)


def date_of(run: Column) -> Column:
    """The date part of a run id, null where it has none."""
    first = F.split_part(run, F.lit("_"), F.lit(1))
    return F.when(F.length(first) == 10, first)


def checked_status(status: Column) -> Column:
    return F.when(status.isin(*STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("no such status: "), F.coalesce(status, F.lit("null")))))


def label_filter(labels: Column, key: str, value: str) -> Column:
    """Whether the JSON object's key has that value; value as JSON would print it."""
    return F.get_json_object(labels, f"$.{key}") == F.lit(value)


def label_like(labels: Column, key: str, value: str) -> Column:
    """The lenient form: a search in the text, which also finds longer values, other cases and nested keys."""
    pattern = f'%"{key}": {value}%'
    return labels.ilike(pattern)


def get_runs(runs: DataFrame, dataset_id: str | None = None, status: str | None = None, labels: dict[str, str] | None = None, latest_only: bool = False, limit: int | None = None, order: str = "timestamp", dedupe_first: bool = False) -> DataFrame:
    """Runs, newest first; an empty argument filters nothing. latest_only takes effect after limit, or before it with dedupe_first."""
    for column, value in (("dataset_id", dataset_id), ("status", status)):
        runs = runs.where(F.col(column) == value) if value else runs
    for key, value in (labels or {}).items():
        runs = runs.where(label_filter(F.col("prompt_labels"), key, value))
    if latest_only and dedupe_first:
        runs = latest_by(runs, ["run_key"], order)
    if limit:
        runs = runs.orderBy(F.desc(order), F.desc("run_id")).limit(limit)
    return latest_by(runs, ["run_key"], order) if latest_only and not dedupe_first else runs


def latest_by(rows: DataFrame, keys: list[str], order: str, tie: str = "run_id") -> DataFrame:
    """The newest row of each key, the largest tie breaker on equal times; an aggregate, so a hot key combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in rows.columns])


def current(events: DataFrame, key: str = "run_id", order: str = "event_no") -> DataFrame:
    """The state that events make: for every column its newest non-null value."""
    rest = [c for c in events.columns if c not in (key, order)]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    return events.groupBy(key).agg(*newest)


def version_history(runs: DataFrame, order: str = "timestamp") -> DataFrame:
    """Each run with the one of its key that it supersedes, and its version number from 1."""
    w = Window.partitionBy("run_key").orderBy(order, "run_id")
    return runs.withColumn("supersedes_run_id", F.lag("run_id").over(w)).withColumn("version", F.row_number().over(w).cast("long"))


def exists(runs: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The wanted keys that some run has."""
    return wanted.join(runs, on, "left_semi")


def unprocessed(prompts: DataFrame, runs: DataFrame, on: list[str]) -> DataFrame:
    """Prompts that no completed run has, by the given keys: what a repeated ingestion has to do."""
    return prompts.join(runs.where(F.col("status") == "completed").select(*on), on, "left_anti")


def within_context(prompts: DataFrame, tokens: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Prompts that fit the context, and the others."""
    fits = F.coalesce(F.col(tokens) <= most, F.lit(True))
    return prompts.where(fits), prompts.where(~fits)


def statistics(runs: DataFrame) -> DataFrame:
    """(what, value, n): runs by status and by dataset, and in all, in one pass."""
    sets = runs.groupingSets([[F.col("status")], [F.col("dataset_id")], []], F.col("status"), F.col("dataset_id")).agg(F.count(F.lit(1)).alias("n"), F.grouping("status").alias("gs"), F.grouping("dataset_id").alias("gd"))
    what = F.when(F.col("gs") == 0, "status").when(F.col("gd") == 0, "dataset").otherwise("total")
    return sets.select(what.alias("what"), F.when(F.col("gs") == 0, F.col("status")).when(F.col("gd") == 0, F.col("dataset_id")).alias("value"), "n")


def storage_gb(artifacts: DataFrame) -> DataFrame:
    return artifacts.agg((F.coalesce(F.sum("size_bytes"), F.lit(0)) / F.pow(F.lit(1024.0), F.lit(3.0))).alias("gb"))


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """Registered again, an artifact of a run and kind replaces the former one."""
    return latest_by(artifacts, ["run_id", "kind"], "created_at", "path")


def without_runs(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    return rows.join(deleted.select("run_id"), "run_id", "left_anti")


def merged_labels(first: Column, second: Column) -> Column:
    """JSON objects as maps, merged: keys of the second win."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(c, kind), F.expr(f"cast(map() as {kind})")) for c in (first, second))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def load_labels(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One column for each key of the labels, null where it is missing."""
    return runs.select("run_id", *[F.get_json_object("prompt_labels", f"$.{k}").alias(k) for k in keys])


def sample_completed(runs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n completed runs, the same for the same seed."""
    done = runs.where(F.col("status") == "completed")
    return done.orderBy(F.md5(F.concat_ws("|", F.col("run_id").cast("string"), F.lit(str(seed)))), "run_id").limit(n)
