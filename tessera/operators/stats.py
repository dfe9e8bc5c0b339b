"""Statistics over sparse and dense matrices: co-occurrence, PMI and NPMI, directions, separability, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matrix import KEY

EPS = 1e-10


def frequency_summary(frequency: DataFrame) -> DataFrame:
    """Mean, median and population deviation of the frequencies of features."""
    return frequency.agg(F.avg("frequency").alias("mean"), F.percentile("frequency", 0.5).alias("median"), F.stddev_pop("frequency").alias("std"), F.count(F.lit(1)).alias("n_features"))


def cooccurrence(matrix: DataFrame) -> DataFrame:
    """(f1, f2, n) for f1 < f2: in how many runs both features are. Restrict to the top features first: the rows of a run pair up."""
    f = matrix.select("run_id", F.struct(*KEY).alias("f")).distinct()
    return f.withColumnRenamed("f", "f1").join(f.withColumnRenamed("f", "f2"), "run_id").where("f1 < f2").groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"))


def pmi(matrix: DataFrame, n_runs: int) -> DataFrame:
    """(f1, f2, n, pmi) for all pairs of the matrix's few features, also those that never meet."""
    frequency = matrix.groupBy(F.struct(*KEY).alias("f")).agg(F.countDistinct("run_id").alias("n"))
    a, b = (frequency.select(F.col("f").alias(f"f{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    grid = a.join(F.broadcast(b), F.col("f1") < F.col("f2"))  # k features, k being the caller's
    total = F.lit(float(n_runs))
    both = F.coalesce("n", F.lit(0))
    value = F.log2((both / total + EPS) / ((F.col("n1") / total) * (F.col("n2") / total) + EPS))
    return grid.join(cooccurrence(matrix), ["f1", "f2"], "left").select("f1", "f2", both.alias("n"), value.alias("pmi"))


def npmi(cells: DataFrame, labels: DataFrame, min_freq: float = 0.0) -> DataFrame:
    """(i, p_x, npmi) of features against a binary label; cells: (run_id, i) where a feature is on; labels: (run_id, y).

    Features no more frequent than min_freq are 0, as are undefined values.
    """
    total = labels.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").cast("double").alias("n_y"))
    seen = cells.select("run_id", "i").distinct().join(labels, "run_id").groupBy("i").agg(F.count(F.lit(1)).alias("on"), F.sum("y").alias("hits"))
    joined = seen.join(F.broadcast(total))  # one row
    p, px, py = F.col("hits") / F.col("n"), F.col("on") / F.col("n"), F.col("n_y") / F.col("n")
    value = F.log2((p + EPS) / ((px + EPS) * py)) / -F.log2(p + EPS)
    clean = F.when((px > min_freq) & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value).otherwise(0.0)
    return joined.select("i", px.alias("p_x"), clean.alias("npmi"))


def npmi_selection(cells: DataFrame, labels: DataFrame, least_class: float = 0.1, most_dataset: float = 0.5, least_freq: float = 0.01) -> DataFrame:
    """(i, class_npmi, dataset_npmi) of features that tell the class, but no dataset; labels: (run_id, y, dataset_id).

    Each dataset's own label comes from counts by (feature, dataset), in one pass over the cells.
    """
    on = cells.select("run_id", "i").distinct()
    of_class = npmi(on, labels.select("run_id", "y"), least_freq).select("i", "p_x", F.col("npmi").alias("class_npmi"))
    sizes = labels.groupBy("dataset_id").agg(F.count(F.lit(1)).cast("double").alias("n_d"))
    n = labels.agg(F.count(F.lit(1)).cast("double").alias("n"))
    by = on.join(labels.select("run_id", "dataset_id"), "run_id").groupBy("i", "dataset_id").agg(F.count(F.lit(1)).alias("hits"))
    known = by.join(F.broadcast(sizes), "dataset_id").join(F.broadcast(n)).join(of_class.select("i", "p_x"), "i")
    p, py = F.col("hits") / F.col("n"), F.col("n_d") / F.col("n")
    of_dataset = known.withColumn("d", F.log2((p + EPS) / ((F.col("p_x") + EPS) * py)) / -F.log2(p + EPS)).groupBy("i").agg(F.max("d").alias("dataset_npmi"))
    return of_class.join(of_dataset, "i").where((F.col("p_x") > least_freq) & (F.col("class_npmi") > least_class) & (F.col("dataset_npmi") < most_dataset)).select("i", "class_npmi", "dataset_npmi")


def long_form(xy: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, v) of vectors x."""
    return xy.select(*keys, F.posexplode("x").alias("i", "v"))


def class_means(xy: DataFrame) -> DataFrame:
    """(i, m0, m1): each dimension's mean in both classes."""
    cell = long_form(xy, "y")
    return cell.groupBy("i").agg(F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("m0"), F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("m1"))


def direction(xy: DataFrame) -> DataFrame:
    """(i, d): the difference of the class means over its norm. A row for each dimension, so it is small."""
    diff = class_means(xy).withColumn("d", F.col("m1") - F.col("m0"))
    norm = diff.agg((F.sqrt(F.sum(F.col("d") * F.col("d"))) + 1e-8).alias("norm"))
    return diff.join(F.broadcast(norm)).select("i", (F.col("d") / F.col("norm")).alias("d"))


def projection(xy: DataFrame, towards: DataFrame) -> DataFrame:
    """(run_id, y, s): vectors projected on a direction (i, d)."""
    norm = towards.agg((F.sqrt(F.sum(F.col("d") * F.col("d"))) + 1e-8).alias("norm"))
    return long_form(xy, "run_id", "y").join(F.broadcast(towards), "i").groupBy("run_id", "y").agg(F.sum(F.col("v") * F.col("d")).alias("s")).join(F.broadcast(norm)).select("run_id", "y", (F.col("s") / F.col("norm")).alias("s"))


def separability(xy: DataFrame) -> DataFrame:
    """One row: distance and cosine of the class means, variances within classes and along the direction, their ratios."""
    by_dim = long_form(xy, "y").groupBy("i").agg(*[f(F.when(F.col("y") == k, F.col("v"))).alias(f"{n}{k}") for k in (0, 1) for f, n in ((F.avg, "m"), (F.var_samp, "v"))])
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    base = by_dim.agg(F.sqrt(F.sum((F.col("m0") - F.col("m1")) ** 2)).alias("l2"), dot("m0", "m1").alias("dot"), F.sqrt(dot("m0", "m0")).alias("n0"), F.sqrt(dot("m1", "m1")).alias("n1"), ((F.avg("v0") + F.avg("v1")) / 2).alias("within"))
    along = projection(xy, direction(xy)).agg(((F.var_samp(F.when(F.col("y") == 0, F.col("s"))) + F.var_samp(F.when(F.col("y") == 1, F.col("s")))) / 2).alias("between"))
    l2 = F.col("l2")
    return base.join(F.broadcast(along)).select(l2, (F.col("dot") / (F.col("n0") * F.col("n1"))).alias("cosine"), (l2 / (F.col("n0") + F.col("n1") + 1e-8)).alias("relative"), "within", "between", (l2 / F.sqrt("within")).alias("l2_within"), (l2 / F.sqrt("between")).alias("l2_between"))


def cluster_statistics(cells: DataFrame, n_rows: int, width: int) -> DataFrame:
    """One row over a sparse matrix (run_id, feature_idx, v), absent cells counting as 0."""
    total = F.lit(float(n_rows * width))
    mean = F.sum("v") / total
    absent = F.count(F.lit(1)) < n_rows * width
    means = cells.groupBy("feature_idx").agg((F.sum("v") / F.lit(float(n_rows))).alias("m")).agg(F.sqrt(F.sum(F.col("m") ** 2)).alias("mean_norm"))
    overall = cells.agg(mean.alias("mean"), F.sqrt(F.sum(F.col("v") ** 2) / total - mean**2).alias("std"), F.when(absent, F.least(F.min("v"), F.lit(0.0))).otherwise(F.min("v")).alias("min"), F.when(absent, F.greatest(F.max("v"), F.lit(0.0))).otherwise(F.max("v")).alias("max"))
    return overall.join(F.broadcast(means))


def vector_statistics(xy: DataFrame, group: str) -> DataFrame:
    """(group, n, d, mean_norm, std): of each cluster's vectors, std being the mean population deviation over dimensions."""
    dims = long_form(xy, group).groupBy(group, "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return dims.groupBy(group).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("d"), F.sqrt(F.sum(F.col("m") ** 2)).alias("mean_norm"), F.avg("s").alias("std"))


def centroids(xy: DataFrame, group: str) -> DataFrame:
    return long_form(xy, group).groupBy(group, "i").agg(F.avg("v").alias("m"))


def histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n, density) over equal bins between the extremes; the right edge belongs to the last bin."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1))
    binned = values.where(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin"), width.alias("w"), "total").agg(F.count(F.lit(1)).alias("n"))
    return binned.select("bin", "n", (F.col("n") / (F.col("total") * F.col("w"))).alias("density"))


def standardized(xy: DataFrame) -> DataFrame:
    """(run_id, i, v): (x - mean) / population deviation by dimension; a deviation of 0 counts as 1."""
    cell = long_form(xy, "run_id")
    by_dim = cell.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return cell.join(F.broadcast(by_dim), "i").select("run_id", "i", ((F.col("v") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("v"))


def max_abs_scaled(xy: DataFrame) -> DataFrame:
    cell = long_form(xy, "run_id")
    by_dim = cell.groupBy("i").agg(F.max(F.abs("v")).alias("s"))
    return cell.join(F.broadcast(by_dim), "i").select("run_id", "i", (F.col("v") / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("v"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column, eps: float = 1e-8) -> Column:
    n = norm(a) + eps
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)
