"""Ranking and classification metrics, thresholds and curves over (score, y) rows.

Curves go through counts by distinct score; their running sums are taken in two levels, so that no task holds all
scores: sums within ranges of scores, and the totals of the few ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps k a key before the shuffle already."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def top_before(rows: DataFrame, positions: DataFrame, key: str, position: str, weight: str, k: int) -> DataFrame:
    """The k rows of largest weight of each key among those before the key's own query position; positions: (key, at)."""
    before = rows.join(positions, key).where(F.col(position) < F.col("at")).drop("at")
    return top_per_key(before, [key], [F.desc(weight), F.asc(position)], k)


def softmax_top_k(logits: DataFrame, key: str, token: str, logit: str, k: int) -> DataFrame:
    """(key, token, p) of each key's k largest logits, p being their softmax over all of them."""
    peak = logits.groupBy(key).agg(F.max(logit).alias("_m"))
    total = logits.join(peak, key).groupBy(key).agg(F.max("_m").alias("_m"), F.sum(F.exp(F.col(logit) - F.col("_m"))).alias("_s"))
    top = top_per_key(logits, [key], [F.desc(logit), F.asc(token)], k)
    return top.join(total, key).select(key, token, (F.exp(F.col(logit) - F.col("_m")) / F.col("_s")).alias("p"))


def curve(scored: DataFrame, *by: str) -> DataFrame:
    """(by, score, tp, fp, n_pos, n_neg): counts at each distinct score as threshold, from the highest.

    The ranges' bounds are quantiles that the driver gets first, as many as there are partitions, so that both levels of
    sums divide the scores alike, whatever is computed again.
    """
    counts = scored.groupBy(*by, "score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).withColumn("q", F.col("n") - F.col("p"))
    number = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = counts.agg(F.percentile_approx("score", [at / number for at in range(1, number)] or [0.5], 10_000).alias("b")).first()["b"] or []
    ends = F.array(*(F.lit(float(bound)) for bound in sorted(set(bounds)))).cast("array<double>")
    part = F.when(F.col("score").isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(ends, lambda bound: bound > F.col("score"))))
    ranged = counts.withColumn("_part", part)
    within = Window.partitionBy("_part", *by).orderBy(F.desc("score"))
    sums = ranged.withColumn("tp", F.sum("p").over(within)).withColumn("fp", F.sum("q").over(within))
    parts = ranged.groupBy("_part", *by).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    offsets = parts.select("_part", *by, F.coalesce(F.sum("p").over(before), F.lit(0)).alias("tp0"), F.coalesce(F.sum("q").over(before), F.lit(0)).alias("fp0"), F.sum("p").over(everything).alias("n_pos"), F.sum("q").over(everything).alias("n_neg"))
    return sums.join(offsets, ["_part", *by]).select(*by, "score", (F.col("tp") + F.col("tp0")).alias("tp"), (F.col("fp") + F.col("fp0")).alias("fp"), F.col("p"), F.col("q"), "n_pos", "n_neg")


def precision_recall(scored: DataFrame) -> DataFrame:
    c = curve(scored)
    return c.select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("n_pos")).alias("recall"))


def roc_auc(scored: DataFrame, *by: str) -> DataFrame:
    """(by, auc): the chance that a positive scores above a negative, ties counting half; null with one class only."""
    c = curve(scored, *by)
    wins = F.sum(F.col("p") * (F.col("n_neg") - F.col("fp") + F.col("q") / F.lit(2.0)))
    return c.groupBy(*by).agg((wins / F.when(F.max(F.col("n_pos") * F.col("n_neg")) > 0, F.max(F.col("n_pos") * F.col("n_neg")).cast("double"))).alias("auc"))


def pr_auc(scored: DataFrame) -> DataFrame:
    """The area below the precision-recall curve by trapezoids, from recall 0 at precision 1; steps between neighbours come from counts."""
    c = curve(scored)
    p1 = F.col("tp") / (F.col("tp") + F.col("fp"))
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("q")
    p0 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    return c.agg(F.sum(F.col("p") / F.col("n_pos") * (p0 + p1) / 2).alias("pr_auc"))


def max_f1(scored: DataFrame) -> DataFrame:
    """(threshold, f1): the best threshold of the curve, the lowest on ties."""
    pr = precision_recall(scored)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-10)
    return pr.select(F.col("score").alias("threshold"), F.round(f1, 12).alias("f1")).orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def target_precision(scored: DataFrame, precision: float) -> DataFrame:
    """(threshold): the percentile of the negatives' scores, which bounds the false-positive rate; the median of all without negatives.

    Exact, between the two scores around the place, which are found in the curve's counts.
    """
    c = curve(scored.where("score IS NOT NULL"))
    above, size, own = F.col("fp") - F.col("q"), F.col("n_neg"), F.col("q")
    every = [F.col("tp") - F.col("p") + above, F.col("n_pos") + size, F.col("p") + own]

    def percentile(above: Column, size: Column, own: Column, share: float) -> Column:
        place = (size - 1) * F.lit(share)
        # of a score's rows, counted from the lowest, the first is size - above - own, the last size - above - 1
        at = lambda rank: F.max(F.when((own > 0) & (size - above - own <= rank), F.col("score")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return c.agg(F.coalesce(F.when(F.max(size) > 0, percentile(above, size, own, precision)), percentile(*every, 0.5)).alias("threshold"))


class Constant:
    """A threshold that is given."""

    def __init__(self, threshold: float = 0.5):
        self.threshold = threshold

    def select(self, scored: DataFrame) -> DataFrame:
        return scored.sparkSession.createDataFrame([(float(self.threshold),)], "threshold double")


class TargetPrecision:
    """The threshold that bounds the false-positive rate by 1 - precision."""

    def __init__(self, precision: float = 0.95):
        self.precision = precision

    def select(self, scored: DataFrame) -> DataFrame:
        return target_precision(scored, self.precision)


class MaxF1:
    def select(self, scored: DataFrame) -> DataFrame:
        return max_f1(scored).select("threshold")


def nearest_point(scored: DataFrame, threshold: float) -> DataFrame:
    """Precision and recall at the curve's point nearest to the threshold, the lower on ties."""
    return precision_recall(scored).orderBy(F.abs(F.col("score") - threshold), "score").limit(1)


def evaluate_predictions(train: DataFrame, test: DataFrame, strategy=None) -> DataFrame:
    """One row with acc, malicious_f1, benign_f1, macro_f1, roc_auc, pr_auc, threshold, recall and precision of the test rows.

    The threshold is chosen on the training rows, by TargetPrecision(0.95) unless told otherwise. All come from one curve of the
    test scores; F1 and areas are percentages, precision and recall those at the curve's point nearest to the threshold, the
    lower on ties. Rows without a score take no part; an F1 without a denominator is 0, areas are null with one class only.
    """
    chosen = (strategy or TargetPrecision(0.95)).select(train).select("threshold")
    c = curve(test.where("score IS NOT NULL")).crossJoin(F.broadcast(chosen))  # one row
    over = F.col("score") >= F.col("threshold")
    at = lambda name: F.coalesce(F.max(F.when(over, F.col(name))), F.lit(0)).alias(name)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("q")
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    recall = F.try_divide(F.col("tp").cast("double"), F.col("n_pos"))
    sums = c.agg(
        at("tp"),
        at("fp"),
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        F.sum(F.col("p") * (F.col("n_neg") - F.col("fp") + F.col("q") / F.lit(2.0))).alias("wins"),
        F.sum(F.col("p") * (before + precision) / 2).alias("area"),
        F.max("threshold").alias("threshold"),
        F.min_by(F.struct(precision.alias("precision"), recall.alias("recall")), F.struct(F.abs(F.col("score") - F.col("threshold")), F.col("score"))).alias("near"),
    )
    fn, tn = F.col("n_pos") - F.col("tp"), F.col("n_neg") - F.col("fp")
    f1 = lambda hit: F.coalesce(F.try_divide(200.0 * hit, 2 * hit + F.col("fp") + fn), F.lit(0.0))
    both = F.when(F.col("n_pos") * F.col("n_neg") > 0, F.lit(100.0))
    return sums.select(
        F.try_divide(F.col("tp") + tn, F.col("n_pos") + F.col("n_neg")).alias("acc"),
        f1(F.col("tp")).alias("malicious_f1"),
        f1(tn).alias("benign_f1"),
        ((f1(F.col("tp")) + f1(tn)) / 2).alias("macro_f1"),
        (both * F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
        (both * F.col("area") / F.col("n_pos")).alias("pr_auc"),
        "threshold",
        F.col("near.recall").alias("recall"),
        F.col("near.precision").alias("precision"),
    )


def predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("prediction", (F.col("score") >= threshold).cast("long"))


def confusion(scored: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of rows with y and prediction, by key; a rate without a denominator is null."""
    count = lambda y, p: F.count(F.when((F.col("y") == y) & (F.col("prediction") == p), 1))
    c = scored.groupBy(*by).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(0, 0).alias("tn"), count(1, 0).alias("fn"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    precision, recall = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    accuracy = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return c.select(*by, "tp", "fp", "tn", "fn", accuracy.alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), ratio("fp", F.col("fp") + F.col("tn")).alias("fpr"))


def weighted_average(metrics: DataFrame, weight: str, *columns: str) -> DataFrame:
    """Means of metrics weighted by size; a null metric and its weight stay out."""
    return metrics.agg(*[(F.sum(F.col(c) * F.col(weight)) / F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))).alias(c) for c in columns])


def class_balance(rows: DataFrame) -> DataFrame:
    """(dataset_id, n, positive_rate) by falling size."""
    return rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("positive_rate"))


def pure_datasets(rows: DataFrame) -> DataFrame:
    """(dataset_id, kind): positive, negative, or mixed; others are left out."""
    rate = F.col("positive_rate")
    kind = F.when(rate > 0.95, "positive").when(rate < 0.05, "negative").when((rate >= 0.1) & (rate <= 0.9), "mixed")
    return class_balance(rows).select("dataset_id", kind.alias("kind")).where("kind IS NOT NULL")


def pivoted(metrics: DataFrame, row: str, column: str, values: list[str] | None, metric: str) -> DataFrame:
    """A row for each dataset, a column for each method; without values these are all that occur, but null."""
    if values is None:
        values = [r[0] for r in metrics.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]
    return metrics.groupBy(row).pivot(column, values).agg(F.max(metric))


def firing_rates(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, benign, malicious, ratio, top_dataset): how often features fire by class, and the dataset where they fire most.

    cells: (run_id, i) where a feature is on; labels: (run_id, y, dataset_id). Ties go to the first dataset by name.
    """
    sizes = labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).groupBy().agg(F.max(F.when(F.col("y") == 0, F.col("n"))).alias("n0"), F.max(F.when(F.col("y") == 1, F.col("n"))).alias("n1"))
    on = cells.select("run_id", "i").distinct().join(labels, "run_id")
    by_class = on.groupBy("i").agg(F.count(F.when(F.col("y") == 0, 1)).alias("c0"), F.count(F.when(F.col("y") == 1, 1)).alias("c1")).join(F.broadcast(sizes))
    rates = by_class.select("i", (F.col("c0") / F.col("n0")).alias("benign"), (F.col("c1") / F.col("n1")).alias("malicious"))
    of = labels.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    fired = on.groupBy("i", "dataset_id").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(of), "dataset_id").withColumn("rate", F.col("c") / F.col("n"))
    top = fired.groupBy("i").agg(F.min_by("dataset_id", F.struct((-F.col("rate")).alias("r"), "dataset_id")).alias("top_dataset"))
    return rates.join(top, "i").withColumn("ratio", F.col("malicious") / F.greatest(F.col("benign"), F.lit(1e-6)))


def retention(baseline: DataFrame, held_out: DataFrame) -> DataFrame:
    """(i, retention, worst): the least coefficient over hold-outs against the baseline, infinite where that isn't positive."""
    worst = held_out.groupBy("i").agg(F.min("coef").alias("least"), F.min_by("dataset_id", F.struct("coef", "dataset_id")).alias("worst"))
    return baseline.join(worst, "i").select("i", F.when(F.col("coef") <= 0, float("inf")).otherwise(F.col("least") / F.col("coef")).alias("retention"), "worst")


def quadrants(rates: DataFrame, kept: DataFrame, least_ratio: float = 1.5, least_kept: float = 0.5) -> DataFrame:
    """Features by whether they fire for the class and whether their coefficient outlasts hold-outs."""
    name = F.when((F.col("ratio") >= least_ratio) & (F.col("retention") >= least_kept), "robust").when(F.col("ratio") >= least_ratio, "dataset_shortcut").when(F.col("retention") >= least_kept, "context").otherwise("weak_shortcut")
    return rates.join(kept, "i").select("i", name.alias("quadrant"))
