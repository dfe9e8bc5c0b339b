"""Prompt-by-feature matrices in coordinate form: frequencies, top features, position selection, exports.

Rows are (run_id, layer, feature_idx, v) or (run_id, position, feature_idx, v). Nothing is pivoted; only the k top
features, k being an argument, are ever broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["layer", "feature_idx"]


def feature_frequency(incidence: DataFrame) -> DataFrame:
    """(layer, feature_idx, frequency, max_v): in how many runs a feature is, and its largest value."""
    return incidence.groupBy(*KEY).agg(F.countDistinct("run_id").alias("frequency"), F.max("v").alias("max_v"))


def not_ubiquitous(frequency: DataFrame, n_runs: int, most: float) -> DataFrame:
    return frequency.where(F.col("frequency") <= int(n_runs * most))


def top_features(frequency: DataFrame, k: int, least: bool = False) -> DataFrame:
    """The k most (or least) frequent features; ties by layer and index."""
    by = F.asc("frequency") if least else F.desc("frequency")
    return frequency.orderBy(by, *KEY).limit(k)


def feature_matrix(incidence: DataFrame, k: int, kind: str = "binary", most: float = 1.0) -> DataFrame:
    """(run_id, layer, feature_idx, v) over the top k features; v is 1, or the largest value, at least 0."""
    n_runs = incidence.select("run_id").distinct().count()
    top = top_features(not_ubiquitous(feature_frequency(incidence), n_runs, most), k)
    cell = F.lit(1.0) if kind == "binary" else F.greatest(F.lit(0.0), F.max("v"))
    return incidence.join(F.broadcast(top.select(*KEY)), KEY).groupBy("run_id", *KEY).agg(cell.alias("v"))


def at_position(acts: DataFrame, which: str | int) -> DataFrame:
    """Rows at a position of each run: "last" (its largest stored one), "first" (0), k, or -k counted from the last."""
    if which == "first" or isinstance(which, int) and which >= 0:
        return acts.where(F.col("position") == (0 if which == "first" else which))
    back = 0 if which == "last" else -which - 1
    last = F.max("position").over(Window.partitionBy("run_id"))
    return acts.withColumn("_last", last).where(F.col("position") == F.col("_last") - back).drop("_last")


def in_range(rows: DataFrame, width: int, column: str = "feature_idx") -> DataFrame:
    return rows.where(F.col(column).between(0, width - 1))


def run_index(rows: DataFrame) -> DataFrame:
    """(run_id, row): the dense index of runs in order of their id, from 0.

    Ranks within ranges of ids plus the runs before each range, so that no task sees all runs. The ranged ids are stored
    once, as ranges that are computed again might be cut elsewhere.
    """
    from ..sources.storage import stored

    ids = rows.select("run_id").distinct()
    spark = rows.sparkSession
    ranged = stored(ids.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "run_id").withColumn("part", F.spark_partition_id()))
    ranged = ranged.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy("run_id")) - 1)
    # the ranges are few, as many as partitions
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(before.select("part", "before")), "part").select("run_id", (F.col("before") + F.col("within")).cast("long").alias("row"))


def resolved_layers(specs: Column, n_layers: Column) -> Column:
    """resolve_layers() of each row's specs, texts: sorted distinct layers for "all" and whole numbers; another is an error."""

    def one(spec: Column) -> Column:
        layer = spec.try_cast("int")
        wrong = F.raise_error(F.concat(F.lit("no such layer: "), spec)).cast("array<int>")
        return F.when(spec == "all", F.sequence(F.lit(0), n_layers - 1)).when(layer.between(0, n_layers - 1), F.array(layer)).otherwise(wrong)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(specs, one))))


def activation_matrix(acts: DataFrame, which: str | int, width: int) -> DataFrame:
    """(row, feature_idx, v) at a position; cells given twice add up."""
    chosen = in_range(at_position(acts, which), width)
    return chosen.join(run_index(chosen), "run_id").groupBy("row", "feature_idx").agg(F.sum("v").alias("v"))


def resolve_positions(specs: Column, length: Column) -> Column:
    """Sorted distinct positions for specs "all", "first", "last" and whole numbers, negative ones from the end.

    A position outside the sequence is an error.
    """
    def one(spec: Column) -> Column:
        number = spec.try_cast("int")
        at = F.when(spec == "first", F.lit(0)).when(spec == "last", length - 1).when(number < 0, length + number).otherwise(number)
        bad = at.isNull() | (at < 0) | (at >= length)
        return F.when(spec == "all", F.sequence(F.lit(0), length - 1)).otherwise(F.array(F.when(bad, F.raise_error(F.concat(F.lit("no such position: "), spec)).cast("int")).otherwise(at)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(specs, one))))


def resolve_layers(specs: list, n_layers: int) -> list[int]:
    """Sorted distinct layers for "all" and whole numbers; none may be negative or too large."""
    out: set[int] = set()
    for spec in specs:
        chosen = range(n_layers) if spec == "all" else [int(spec)]
        if any(not 0 <= layer < n_layers for layer in chosen):
            raise ValueError(f"no such layer: {spec}")
        out.update(chosen)
    return sorted(out)


def at_all_positions(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """stored rows at the wanted (run_id, position), only of runs that have every wanted position."""
    w = wanted.select("run_id", "position").distinct()
    needed = w.groupBy("run_id").agg(F.count(F.lit(1)).alias("needed"))
    hit = stored.join(w, ["run_id", "position"])
    complete = hit.groupBy("run_id").agg(F.countDistinct("position").alias("have")).join(needed, "run_id").where("have = needed").select("run_id")
    return hit.join(complete, "run_id", "left_semi")


def dense_to_coordinates(vectors: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Non-zero components, negative ones too, as (keys, feature_idx, v)."""
    return vectors.select(*keys, F.posexplode(vector).alias("feature_idx", "v")).where("v <> 0").withColumn("v", F.col("v").cast("double"))


def graph_features(graphs: DataFrame) -> DataFrame:
    """Features of compact graphs as incidence rows; is_last_pos marks those at the last input token."""
    rows = graphs.select("run_id", (F.size("input_tokens") - 1).alias("last"), F.explode("features").alias("f")).select("run_id", "f.*", "last")
    return rows.withColumn("is_last_pos", F.col("position") == F.col("last")).drop("last")


def checked_features(features: Column) -> Column:
    """An array of features; a negative layer, position or index is an error."""
    bad = F.exists(features, lambda f: (f["layer"] < 0) | (f["position"] < 0) | (f["feature_idx"] < 0))
    return F.when(bad, F.raise_error(F.lit("a feature's layer, position or index is negative"))).otherwise(features)


def top_by_influence(graphs: DataFrame, k: int) -> DataFrame:
    """Each graph's k most influential features, as an array within the row."""
    falling = F.array_sort("features", lambda a, b: F.when(a["influence"] > b["influence"], -1).when(a["influence"] < b["influence"], 1).when(a["feature_idx"] < b["feature_idx"], -1).when(a["feature_idx"] > b["feature_idx"], 1).otherwise(0))
    return graphs.withColumn("features", F.slice(falling, 1, k))


def sequence_reduction(acts: DataFrame, how: str) -> DataFrame:
    """(run_id, feature_idx, v) over a run's positions: "mean" over its stored positions, "max" or "last"."""
    if how == "last":
        return at_position(acts, "last").select("run_id", "feature_idx", "v")
    if how == "max":
        return acts.groupBy("run_id", "feature_idx").agg(F.max("v").alias("v"))
    n = acts.groupBy("run_id").agg(F.countDistinct("position").alias("n"))
    return acts.groupBy("run_id", "feature_idx").agg(F.sum("v").alias("s")).join(n, "run_id").select("run_id", "feature_idx", (F.col("s") / F.col("n")).alias("v"))


def sparsity(rows: DataFrame, n_rows: int, width: int) -> DataFrame:
    return rows.agg((1 - F.count(F.lit(1)) / F.lit(float(n_rows * width))).alias("sparsity"))
