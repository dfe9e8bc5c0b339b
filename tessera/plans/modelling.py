"""Queries over models, folds and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import layout as L
from ..operators import metrics as M
from ..operators import projection as PR
from ..operators import stats as S
from ..operators import unsupervised as U
from ..operators.adversarial import Adversarial
from ..operators.checkpoints import coefficient_rows
from ..operators.prototypes import COVARIANCES, Prototypes
from ..sources import views as V
from ..sources.storage import stored
from .analyzers import UnsupervisedAnalyzer
from .catalog import query

X_ = f"WITH {V.XY}, {V.XYC}"
MEAN = ", mu AS (SELECT i, avg(v) FILTER (y = 0) AS m0, avg(v) FILTER (y = 1) AS m1 FROM xyc GROUP BY i)"
DIST = ", ds AS (SELECT run_id, any_value(y) AS y, sqrt(sum(pow(v - m0, 2))) AS s, sqrt(sum(pow(v - m1, 2))) AS u, sum(v * m0) / (sqrt(sum(v * v)) * sqrt(sum(m0 * m0)) + 1e-10) AS c0, sum(v * m1) / (sqrt(sum(v * v)) * sqrt(sum(m1 * m1)) + 1e-10) AS c1 FROM xyc JOIN mu USING (i) GROUP BY run_id)"


def scored(df):
    return df.select("run_id", "y", F.round("score", 6).alias("score"))


for _scoring, _sql in (("ratio", "s / (s + u + 1e-10)"), ("softmax", "1 / (1 + exp((u * u - s * s) / 2))"), ("raw", "-u")):

    @query(f"ML20_prototypes_euclidean_{_scoring}", f"{X_}{MEAN}{DIST} SELECT run_id, y, round({_sql}, 6) AS score FROM ds")
    def euclidean(spark, d, scoring=_scoring):
        x = V.xy(spark, d)
        return scored(Prototypes("euclidean", scoring=scoring).fit(x).scores(x))


@query("ML20_prototypes_cosine", f"{X_}{MEAN}{DIST} SELECT run_id, y, round((1 - c0) / (1 - c0 + 1 - c1 + 1e-10), 6) AS score FROM ds")
def cosine(spark, d):
    x = V.xy(spark, d)
    return scored(Prototypes("cosine", scoring="ratio").fit(x).scores(x))


for _covariance in COVARIANCES:

    @query(f"ML20_prototypes_mahalanobis_{_covariance}")
    def mahalanobis(spark, d, covariance=_covariance):
        x = V.xy(spark, d)
        return scored(Prototypes("mahalanobis", covariance).fit(x).scores(x))


LODO = X_ + ", t AS (SELECT DISTINCT dataset_id AS held FROM xy), mu AS (SELECT held, i, avg(v) FILTER (y = 0) AS m0, avg(v) FILTER (y = 1) AS m1 FROM xyc, t WHERE dataset_id <> held GROUP BY held, i), ds AS (SELECT run_id, any_value(y) AS y, any_value(dataset_id) AS dataset_id, sqrt(sum(pow(v - m0, 2))) AS s, sqrt(sum(pow(v - m1, 2))) AS u FROM xyc JOIN mu ON mu.i = xyc.i AND held = dataset_id GROUP BY run_id), sc AS (SELECT run_id, y, dataset_id, round(s / (s + u + 1e-10), 6) AS score FROM ds)"


@query("ML25_lodo_scores", LODO + " SELECT run_id, dataset_id, y, score FROM sc")
def lodo(spark, d):
    return C.lodo_scores(Prototypes("euclidean", scoring="ratio"), V.xy(spark, d)).select("run_id", "dataset_id", "y", F.round("score", 6).alias("score"))


@query("ML25_ML24_lodo_metrics", LODO + ", k AS (SELECT dataset_id, count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 0 AND score < 0.5) AS tn, count(*) FILTER (y = 1 AND score < 0.5) AS fn FROM sc GROUP BY dataset_id) SELECT dataset_id, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM k")
def lodo_metrics(spark, d):
    s = C.lodo_scores(Prototypes("euclidean", scoring="ratio"), V.xy(spark, d)).withColumn("score", F.round("score", 6))
    m = M.confusion(M.predicted(s, 0.5), "dataset_id")
    return m.select("dataset_id", "tp", "fp", "tn", "fn", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query("ML26_folds", "SELECT vec_id AS run_id, CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 5 AS fold FROM embeddings")
def folds(spark, d):
    return C.with_fold(V.xy(spark, d), 5).select("run_id", "fold")


@query("ML28_stratified_split", f"WITH {V.XY}, k AS (SELECT run_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(run_id AS VARCHAR) || '|42'), run_id) AS k, count(*) OVER (PARTITION BY y) AS n FROM xy) SELECT run_id, CASE WHEN k <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM k")
def stratified(spark, d):
    return C.stratified_split(V.xy(spark, d), 0.2).select("run_id", "part")


OUT = X_ + ", f AS (SELECT *, CAST('0x' || substr(md5(CAST(run_id AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 5 AS fold FROM xyc), t AS (SELECT DISTINCT fold AS held FROM f), mu AS (SELECT held, i, avg(v) FILTER (y = 0) AS m0, avg(v) FILTER (y = 1) AS m1 FROM f, t WHERE fold <> held GROUP BY held, i), ds AS (SELECT run_id, any_value(y) AS y, sqrt(sum(pow(v - m0, 2))) AS s, sqrt(sum(pow(v - m1, 2))) AS u FROM f JOIN mu ON mu.i = f.i AND held = fold GROUP BY run_id)"


@query("ML26_out_of_fold", OUT + " SELECT run_id, y, round(s / (s + u + 1e-10), 6) AS score FROM ds")
def out_of_fold(spark, d):
    return scored(C.out_of_fold(Prototypes("euclidean", scoring="ratio"), V.xy(spark, d)))


@query("ML16_linear")
def linear(spark, d):
    x = V.xy(spark, d)
    return scored(C.linear().fit(x).scores(x))


@query("ML16_linear_optimum", "SELECT CAST(i AS BIGINT) AS i, 0.0::DOUBLE AS gradient FROM (SELECT unnest(range(max(len(embedding)))) AS i FROM embeddings)")
def linear_optimum(spark, d):
    """The gradient of the penalised loss at the fitted coefficients: none at the optimum, to three places."""
    x = V.xy(spark, d)
    model = C.linear().fit(x)
    rows = C.balanced(model.scores(x).withColumn("x", S.l2_normalized(F.col("x"), 0.0)))
    total, n = rows.agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).first()
    by_dim = S.long_form(rows.withColumn("g", F.col("w") * (F.col("score") - F.col("y"))), "g").groupBy("i").agg((F.sum(F.col("g") * F.col("v")) / total).alias("slope"))
    both = by_dim.join(F.broadcast(coefficient_rows(spark, model.weights())), "i")
    return both.select(F.col("i").cast("long").alias("i"), F.round(F.abs(F.col("slope") + F.col("coef") / n), 3).alias("gradient"))


@query("ML17_linear_sgd")
def linear_sgd(spark, d):
    x = V.xy(spark, d)
    return scored(C.linear(c=100.0, sgd=True).fit(x).scores(x))


@query("ML18_boosted")
def boosted(spark, d):
    x = V.xy(spark, d)
    return scored(C.boosted().fit(x).scores(x))


@query("ML18_first_cut", f"""{X_}, c AS (SELECT i, CAST(floor(v * 64) AS BIGINT) AS b, sum(CASE WHEN y = 1 THEN 2 * -0.5 ELSE 0.5 END) AS g, sum(CASE WHEN y = 1 THEN 2 ELSE 1 END) * 0.25 AS h FROM xyc GROUP BY ALL),
    r AS (SELECT i, b, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER (PARTITION BY i) AS g, sum(h) OVER (PARTITION BY i) AS h FROM c WINDOW o AS (PARTITION BY i ORDER BY b)),
    k AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM r WHERE hl >= 1 AND h - hl >= 1)
    SELECT i AS feature, (b + 1) / 64.0::DOUBLE AS cut, round(gain, 6) AS gain, round(-0.3 * gl / (hl + 1), 6) AS lower, round(-0.3 * (g - gl) / (h - hl + 1), 6) AS upper FROM k ORDER BY round(gain, 9) DESC, i, b LIMIT 1""")
def first_cut(spark, d):
    """The first cut of a tree over bins of 1/64, rows of class 1 counting twice."""
    grid = np.arange(-640, 641) / 64
    x = V.xy(spark, d)
    width = x.agg(F.max(F.size("x"))).first()[0]
    tree = C.boosted(trees=1, depth=1, positive_weight=2.0).fit(x, [grid] * width).trees[0]
    row = (int(tree.feature[0]), float(tree.cut[0]), *(round(float(v), 6) for v in (tree.gain[0], *tree.value[1:])))
    return spark.createDataFrame([row], "feature long, cut double, gain double, lower double, upper double")


@query("ML19_neural")
def neural(spark, d):
    x = V.xy(spark, d)
    return scored(C.neural((64, 16, 2)).fit(x).scores(x))


@query("ML19_adversarial")
def adversarial(spark, d):
    x = V.xy(spark, d)
    return scored(Adversarial(domain_weight=0.1).fit(x).scores(x))


@query("ML7_AG22_pca_moments")
def pca(spark, d):
    z, _ = U.pca(V.xy(spark, d), 2)
    return z.groupBy("dataset_id").agg(*[F.round(f(F.col("z")[k]), 6).alias(f"{n}{k}") for k in (0, 1) for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


@query("ML7_total_variance", f"{X_}, t AS (SELECT i, var_pop(v) AS s FROM xyc GROUP BY i) SELECT round(sum(s), 6) AS total FROM t")
def total_variance(spark, d):
    """All components together have the variance of all dimensions."""
    x = V.xy(spark, d)
    z, _ = U.pca(x, x.agg(F.max(F.size("x"))).first()[0])
    return S.long_form(z.select(F.col("z").alias("x"))).groupBy("i").agg(F.var_pop("v").alias("s")).agg(F.round(F.sum("s"), 6).alias("total"))


@query("ML7_components_of_features", f"WITH {V.INCIDENCE}, n AS (SELECT count(DISTINCT run_id) AS n FROM incidence), i AS (SELECT layer, feature_idx, sum(v * v) / any_value(n) - pow(sum(v) / any_value(n), 2) AS s FROM incidence, n GROUP BY layer, feature_idx) SELECT round(sum(s), 6) AS total, round(sum(s), 6) AS explained FROM i")
def components_of_features(spark, d):
    """Rows by the coordinates of what isn't zero: all components together have the variance of all dimensions."""
    cells = V.incidence(spark, d).select("run_id", (F.col("layer") * 16 + F.col("feature_idx")).alias("feature_idx"), "v")
    rows = PR.by_coordinates(cells)
    width = rows.agg(F.max(F.array_max("feature_idx")) + 1).first()[0]
    found = PR.components(rows, width, width)
    return spark.createDataFrame([(round(found.total, 6), round(float(found.variances.sum()), 6))], "total double, explained double")


@query("ML27_tsne")
def tsne(spark, d):
    """Places of a sample of at most SAMPLE_ROWS runs, which is the operator's feature."""
    return L.sampled_layout(V.xy(spark, d), steps=250)


@query("WN8_cumulative_variance")
def cumulative_variance(spark, d):
    """(component, explained, cumulative): shares of the variance, the first components first."""
    _, explained = U.pca(V.xy(spark, d), 10)
    rows = zip(range(1, 11), explained, U.cumulative(explained))
    return spark.createDataFrame([(at, round(one, 6), round(so_far, 6)) for at, one, so_far in rows], "component int, explained double, cumulative double")


@query("ML12_unsupervised")
def unsupervised(spark, d):
    out = UnsupervisedAnalyzer(n_components=8, n_clusters=4).run(V.xy(spark, d).select("run_id", "x"))
    return out["cluster_sizes"].withColumn("silhouette", F.lit(round(out["silhouette"], 6)))


@query("ML9_ML12_kmeans")
def kmeans(spark, d):
    return U.kmeans(V.xy(spark, d), 5).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


NEAR = f"WITH RECURSIVE {V.XY}, pr AS (SELECT a.run_id AS a, b.run_id AS b FROM xy a JOIN xy b ON a.run_id <> b.run_id AND list_distance(a.x, b.x) <= 1.12), core AS (SELECT a AS node FROM pr GROUP BY a HAVING count(*) + 1 >= 3), e AS (SELECT a, b FROM pr WHERE a IN (SELECT node FROM core) AND b IN (SELECT node FROM core)), reach AS (SELECT node, node AS root FROM core UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node), roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node), border AS (SELECT pr.b, min(root) AS near FROM pr JOIN roots ON pr.a = roots.node GROUP BY pr.b)"


@query("ML10_dbscan", NEAR + " SELECT xy.run_id, coalesce(root, near, -1) AS cluster FROM xy LEFT JOIN roots ON node = run_id LEFT JOIN border ON border.b = run_id")
def dbscan(spark, d):
    return U.dbscan(V.xy(spark, d), 1.12, 3, stored)


@query("ML11_silhouette", f"WITH {V.XY}, p AS (SELECT a.run_id, a.label AS own, b.label AS cluster, sum(list_distance(a.x, b.x)) AS total, count(*) AS n FROM xy a, xy b GROUP BY 1, 2, 3), r AS (SELECT run_id, max(total) FILTER (own = cluster) AS t, max(n) FILTER (own = cluster) AS size, min(total / n) FILTER (own <> cluster) AS b FROM p GROUP BY run_id) SELECT round(avg(CASE WHEN size > 1 THEN (b - t / (size - 1)) / greatest(t / (size - 1), b) ELSE 0 END), 6) AS silhouette FROM r")
def silhouette(spark, d):
    return U.silhouette(V.xy(spark, d).withColumn("cluster", F.col("label"))).select(F.round("silhouette", 6).alias("silhouette"))


@query("ML29_ML30_dataset_load", f"WITH {V.XY} SELECT dataset_id, y, count(*) AS n, round(avg(x[1]), 6) AS first FROM xy GROUP BY dataset_id, y")
def dataset_load(spark, d):
    return V.xy(spark, d).groupBy("dataset_id", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x")[0]), 6).alias("first"))
