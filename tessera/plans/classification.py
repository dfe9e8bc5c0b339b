"""Queries over metrics, thresholds and leave-one-dataset-out tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import metrics as M
from ..operators import stats as S
from ..operators.prototypes import Prototypes
from ..sources import views as V
from . import inference
from .catalog import query

S_ = f"WITH {V.SCORES}, c AS (SELECT score, sum(y)::BIGINT AS p, count(*) - sum(y)::BIGINT AS q FROM scores GROUP BY score), r AS (SELECT score, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nn FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), pr AS (SELECT score, tp / (tp + fp) AS precision, tp / np AS recall FROM r)"
P_ = f"WITH {V.SCORES}, pd AS (SELECT *, CAST(score >= 100 AS BIGINT) AS prediction FROM scores)"


def rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


@query("WN5_precision_recall", S_ + " SELECT score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr")
def precision_recall(spark, d):
    return rounded(M.precision_recall(V.scores(spark, d)), "precision", "recall")


@query("WN6_roc_auc", S_ + " SELECT round(sum(p * (nn - fp + q / 2.0)) / any_value(np * nn), 6)::DOUBLE AS auc FROM r")
def roc_auc(spark, d):
    return rounded(M.roc_auc(V.scores(spark, d)), "auc")


@query("WN6_roc_auc_by_dataset", f"WITH {V.SCORES}, k AS (SELECT dataset_id, y, rank() OVER (PARTITION BY dataset_id ORDER BY score) + (count(*) OVER (PARTITION BY dataset_id, score) - 1) / 2.0 AS rk FROM scores) SELECT dataset_id, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6)::DOUBLE AS auc FROM k GROUP BY dataset_id")
def roc_auc_by(spark, d):
    return rounded(M.roc_auc(V.scores(spark, d), "dataset_id"), "auc")


@query("WN7_pr_auc", S_ + ", l AS (SELECT p / np AS dr, precision AS p1, lag(precision, 1, 1) OVER (ORDER BY r.score DESC) AS p0 FROM r JOIN pr USING (score)) SELECT round(sum(dr * (p0 + p1) / 2), 6) AS pr_auc FROM l")
def pr_auc(spark, d):
    return rounded(M.pr_auc(V.scores(spark, d)), "pr_auc")


@query("TK10_ML23_max_f1", S_ + ", f AS (SELECT score AS threshold, round(2 * precision * recall / (precision + recall + 1e-10), 12) AS f1 FROM pr) SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1")
def max_f1(spark, d):
    return rounded(M.max_f1(V.scores(spark, d)), "f1")


@query("ML23_target_precision", f"WITH {V.SCORES} SELECT round(quantile_cont(score, 0.95), 6) AS threshold FROM scores WHERE y = 0")
def target_precision(spark, d):
    return rounded(M.target_precision(V.scores(spark, d), 0.95), "threshold")


@query("TK11_nearest_point", S_ + " SELECT score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr ORDER BY abs(score - 33.3), score LIMIT 1")
def nearest_point(spark, d):
    return rounded(M.nearest_point(V.scores(spark, d), 33.3), "precision", "recall")


CONF = "count(*) FILTER (y = 1 AND prediction = 1) AS tp, count(*) FILTER (y = 0 AND prediction = 1) AS fp, count(*) FILTER (y = 0 AND prediction = 0) AS tn, count(*) FILTER (y = 1 AND prediction = 0) AS fn"
RATES = "tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr"
NAMES = ("accuracy", "precision", "recall", "f1", "fpr")


@query("AG14_ML22_confusion_by_dataset", P_ + f", k AS (SELECT dataset_id, {CONF} FROM pd GROUP BY dataset_id) SELECT dataset_id, {RATES} FROM k")
def confusion(spark, d):
    return rounded(M.confusion(M.predicted(V.scores(spark, d), 100), "dataset_id"), *NAMES)


@query("AG15_ML24_overall", P_ + f", k AS (SELECT {CONF} FROM pd) SELECT {RATES} FROM k")
def overall(spark, d):
    return rounded(M.confusion(M.predicted(V.scores(spark, d), 100)), *NAMES)


@query("ML24_evaluation", f"""WITH {V.SCORES}, t AS (SELECT round(quantile_cont(score, 0.95), 9) AS threshold FROM scores WHERE y = 0 AND run_id % 3 = 0), e AS (SELECT * FROM scores WHERE run_id % 3 > 0),
    k AS (SELECT {CONF}, any_value(threshold) AS threshold FROM (SELECT y, CAST(score >= threshold AS BIGINT) AS prediction, threshold FROM e, t)),
    c AS (SELECT score, sum(y)::BIGINT AS p, count(*) - sum(y)::BIGINT AS q FROM e GROUP BY score), r AS (SELECT score, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nn FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    pr AS (SELECT *, tp / (tp + fp) AS precision, tp / np AS recall, lag(tp / (tp + fp), 1, 1) OVER (ORDER BY score DESC) AS before FROM r),
    a AS (SELECT 100 * sum(p * (nn - fp + q / 2.0)) / any_value(np * nn) AS roc_auc, 100 * sum(p / np * (before + precision) / 2) AS pr_auc FROM pr),
    n AS (SELECT precision, recall FROM pr, t ORDER BY abs(score - threshold), score LIMIT 1)
    SELECT round((tp + tn) / (tp + fp + tn + fn), 6) AS acc, round(200 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS malicious_f1, round(200 * tn / (2 * tn + fp + fn), 6)::DOUBLE AS benign_f1, round(100 * tp / (2 * tp + fp + fn) + 100 * tn / (2 * tn + fp + fn), 6)::DOUBLE AS macro_f1,
           round(roc_auc, 6)::DOUBLE AS roc_auc, round(pr_auc, 6)::DOUBLE AS pr_auc, round(threshold, 6)::DOUBLE AS threshold, round(recall, 6) AS recall, round(precision, 6) AS precision FROM k, a, n""")
def evaluation(spark, d):
    """A threshold chosen on a third of the rows, the nine metrics on the others."""
    rows = V.scores(spark, d)
    found = M.evaluate_predictions(rows.where("run_id % 3 = 0"), rows.where("run_id % 3 > 0"))
    return rounded(found, *found.columns)


@query("AG16_weighted_average", P_ + f", k AS (SELECT dataset_id, count(*) AS n, {CONF} FROM pd GROUP BY dataset_id), m AS (SELECT n, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + tn) / n AS accuracy FROM k) SELECT round(sum(f1 * n) / sum(n) FILTER (f1 IS NOT NULL), 6) AS f1, round(sum(accuracy * n) / sum(n), 6) AS accuracy FROM m")
def weighted_average(spark, d):
    c = M.confusion(M.predicted(V.scores(spark, d), 100), "dataset_id").withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return rounded(M.weighted_average(c, "n", "f1", "accuracy"), "f1", "accuracy")


@query("AG13_class_balance", f"WITH {V.SCORES} SELECT dataset_id, count(*) AS n, round(avg(y), 6) AS positive_rate FROM scores GROUP BY dataset_id")
def class_balance(spark, d):
    return rounded(M.class_balance(V.scores(spark, d)), "positive_rate")


@query("FLT14_pure_datasets", f"WITH {V.XY} SELECT label AS dataset_id, CASE WHEN avg(y) > 0.95 THEN 'positive' ELSE 'negative' END AS kind FROM xy GROUP BY label")
def pure_datasets(spark, d):
    return M.pure_datasets(V.xy(spark, d).select(F.col("label").alias("dataset_id"), "y"))


@query("AG28_pivot", f"WITH {V.RUNS} SELECT dataset_id, max(n_chars) FILTER (lang = 'de') AS de, max(n_chars) FILTER (lang = 'en') AS en, max(n_chars) FILTER (lang = 'es') AS es, max(n_chars) FILTER (lang = 'fr') AS fr FROM runs GROUP BY dataset_id UNION ALL SELECT 'total', max(n_chars) FILTER (lang = 'de'), max(n_chars) FILTER (lang = 'en'), max(n_chars) FILTER (lang = 'es'), max(n_chars) FILTER (lang = 'fr') FROM runs")
def pivot(spark, d):
    """A column for each language that occurs; the SQL names those of the given tables."""
    table = M.pivoted(V.runs(spark, d), "dataset_id", "lang", None, "n_chars")
    return table.unionByName(table.agg(*[F.max(c).alias(c) for c in table.columns if c != "dataset_id"]).withColumn("dataset_id", F.lit("total")))


XO = f"WITH {V.XY}, {V.XYC}, oncell AS (SELECT run_id, i, y, dataset_id FROM xyc WHERE v > 0.15)"
RATE = XO + ", n AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM xy), cl AS (SELECT i, count(*) FILTER (y = 0) / any_value(n0) AS benign, count(*) FILTER (y = 1) / any_value(n1) AS malicious FROM oncell, n GROUP BY i), fd AS (SELECT i, dataset_id, count(*) / any_value(nd) AS rate FROM oncell JOIN (SELECT dataset_id, count(*) AS nd FROM xy GROUP BY dataset_id) USING (dataset_id) GROUP BY i, dataset_id), td AS (SELECT i, dataset_id AS top_dataset FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY rate DESC, dataset_id) AS k FROM fd) WHERE k = 1), fr AS (SELECT i, benign, malicious, malicious / greatest(benign, 1e-6) AS ratio, top_dataset FROM cl JOIN td USING (i))"
COEF = ", cf AS (SELECT i, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS coef FROM xyc GROUP BY i), hd AS (SELECT t.dataset_id, i, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS coef FROM xyc, (SELECT DISTINCT dataset_id FROM xy) t WHERE xyc.dataset_id <> t.dataset_id GROUP BY t.dataset_id, i), rt AS (SELECT i, CASE WHEN any_value(cf.coef) <= 0 THEN 'infinity'::DOUBLE ELSE min(hd.coef) / any_value(cf.coef) END AS retention, min_by(hd.dataset_id, (hd.coef, hd.dataset_id)) AS worst FROM cf JOIN hd USING (i) GROUP BY i)"


def _on(spark, d):
    x = V.xy(spark, d)
    return x.select("run_id", F.posexplode("x").alias("p", "v")).where("v > 0.15").select("run_id", F.col("p").cast("long").alias("i")), x.select("run_id", "y", "dataset_id")


def _coefficients(spark, d):
    """A coefficient for each feature, in all and with each dataset held out: the difference of class means from sums by dataset."""
    cell = S.long_form(V.xy(spark, d), "y", "dataset_id").withColumn("i", F.col("i").cast("long"))
    sums = cell.groupBy("i", "dataset_id", "y").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    mean = lambda y: F.sum(F.when(F.col("y") == y, F.col("s"))) / F.sum(F.when(F.col("y") == y, F.col("n")))
    baseline = sums.groupBy("i").agg((mean(1) - mean(0)).alias("coef"))
    folds = sums.select("dataset_id").distinct().withColumnRenamed("dataset_id", "held")
    held = sums.join(F.broadcast(folds), F.col("held") != F.col("dataset_id")).groupBy("held", "i").agg((mean(1) - mean(0)).alias("coef")).withColumnRenamed("held", "dataset_id")
    return baseline, held


@query("AG17_firing_rates", RATE + " SELECT i, round(benign, 6) AS benign, round(malicious, 6) AS malicious, round(ratio, 6) AS ratio, top_dataset FROM fr")
def firing_rates(spark, d):
    return rounded(M.firing_rates(*_on(spark, d)), "benign", "malicious", "ratio")


@query("AG18_retention", XO + COEF + " SELECT i, round(retention, 6) AS retention FROM rt")
def retention(spark, d):
    return rounded(M.retention(*_coefficients(spark, d)).select("i", "retention"), "retention")


@query("AG19_quadrants", RATE + COEF + " SELECT quadrant, count(*) AS n FROM (SELECT i, CASE WHEN ratio >= 1.5 AND retention >= 0.5 THEN 'robust' WHEN ratio >= 1.5 THEN 'dataset_shortcut' WHEN retention >= 0.5 THEN 'context' ELSE 'weak_shortcut' END AS quadrant FROM fr JOIN rt USING (i)) GROUP BY quadrant")
def quadrants(spark, d):
    return M.quadrants(M.firing_rates(*_on(spark, d)), M.retention(*_coefficients(spark, d))).groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"))


INFLUENCE = f"WITH {V.XY}, {V.XYC}, cf AS (SELECT i, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS coef FROM xyc GROUP BY i), c AS (SELECT run_id, i, round(v * coef, 9) AS influence FROM xyc JOIN cf USING (i))"
#: An order of weights for each direction, as SQL.
ORDER = {"positive": "{} DESC", "negative": "{}", "abs": "abs({}) DESC"}

for _direction, _order in ORDER.items():

    @query(f"TK5_JN10_influence_{_direction}", INFLUENCE + f" SELECT run_id, i, round(influence, 6) AS influence FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_order.format('influence')}, i) AS k FROM c) WHERE k <= 3")
    def influence(spark, d, direction=_direction):
        coef = _coefficients(spark, d)[0]  # a row for each dimension
        cells = S.long_form(V.xy(spark, d), "run_id").withColumn("i", F.col("i").cast("long")).join(F.broadcast(coef), "i")
        c = cells.select("run_id", F.col("i").alias("feature_idx"), F.round(F.col("v") * F.col("coef"), 9).alias("contribution"))
        return inference.ranked_influences(c, "run_id", 3, direction).select("run_id", F.col("feature_idx").alias("i"), F.round("contribution", 6).alias("influence"))

    @query(f"TK6_top_coefficients_{_direction}", f"WITH {V.XY}, {V.XYC}, cf AS (SELECT i, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS coef FROM xyc GROUP BY i) SELECT i, round(coef, 6) AS coef FROM cf ORDER BY {_order.format('cf.coef')}, i LIMIT 10")
    def top_coefficients(spark, d, direction=_direction):
        model = Prototypes("euclidean").fit(V.xy(spark, d))
        rows = [(i, float(model.means[1][i] - model.means[0][i])) for i in model.top_features(10, direction)]
        return rounded(spark.createDataFrame(rows, "i long, coef double"), "coef")


@query("TK6_top_coefficients_both", f"WITH {V.XY}, {V.XYC}, cf AS (SELECT i, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS coef FROM xyc GROUP BY i) SELECT * FROM (SELECT i, 'first' AS part FROM cf ORDER BY coef DESC, i LIMIT 5) UNION ALL SELECT * FROM (SELECT i, 'second' AS part FROM cf ORDER BY coef, i LIMIT 5)")
def top_coefficients_both(spark, d):
    found = Prototypes("euclidean").fit(V.xy(spark, d)).top_features(5, "both")
    return spark.createDataFrame([(i, "first" if at < 5 else "second") for at, i in enumerate(found)], "i long, part string")


def _fitted(spark, d):
    """Coefficients of a linear model, and of one for each dataset held out."""
    return C.lodo_coefficients(C.linear(), V.xy(spark, d))


@query("AG18_retention_fitted")
def retention_fitted(spark, d):
    return rounded(M.retention(*_fitted(spark, d)), "retention")


@query("AG19_quadrants_fitted")
def quadrants_fitted(spark, d):
    return M.quadrants(M.firing_rates(*_on(spark, d)), M.retention(*_fitted(spark, d))).groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"))


for _name, _strategy, _sql in (
    ("constant", M.Constant(0.25), "SELECT 0.25::DOUBLE AS threshold"),
    ("target_precision", M.TargetPrecision(0.9), f"WITH {V.SCORES} SELECT round(quantile_cont(score, 0.9), 6) AS threshold FROM scores WHERE y = 0"),
    ("max_f1", M.MaxF1(), S_ + " SELECT score AS threshold FROM pr ORDER BY round(2 * precision * recall / (precision + recall + 1e-10), 12) DESC, score LIMIT 1"),
):

    @query(f"UX4_threshold_{_name}", _sql)
    def threshold(spark, d, strategy=_strategy):
        return rounded(strategy.select(V.scores(spark, d)), "threshold")


@query("SO3_feature_sets", XO + ", a AS (SELECT DISTINCT i FROM oncell WHERE dataset_id = 0 AND y = 1), b AS (SELECT DISTINCT i FROM oncell WHERE dataset_id = 1 AND y = 1) SELECT 'both' AS what, count(*) AS n FROM (SELECT i FROM a INTERSECT SELECT i FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT i FROM a EXCEPT SELECT i FROM b)")
def feature_sets(spark, d):
    on, labels = _on(spark, d)
    rows = on.join(labels.where("y = 1"), "run_id")
    a, b = (rows.where(F.col("dataset_id") == k).select("i") for k in (0, 1))
    n = F.count(F.lit(1)).alias("n")
    return a.intersect(b).agg(n).select(F.lit("both").alias("what"), "n").unionByName(a.subtract(b).agg(n).select(F.lit("first").alias("what"), "n"))


@query("SO5_fold_masks", f"WITH {V.XY}, t AS (SELECT DISTINCT dataset_id AS fold FROM xy) SELECT fold, count(*) FILTER (dataset_id <> fold) AS train, count(*) FILTER (dataset_id = fold) AS test FROM xy, t GROUP BY fold")
def fold_masks(spark, d):
    x = V.xy(spark, d).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    total = x.agg(F.sum("n").alias("total"))
    return x.join(F.broadcast(total)).select(F.col("dataset_id").alias("fold"), (F.col("total") - F.col("n")).alias("train"), F.col("n").alias("test"))
