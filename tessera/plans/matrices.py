"""Queries over sparse feature matrices and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import matrix as M
from ..operators import stats as S
from ..sources import views as V
from ..sources.storage import stored
from .catalog import query

I_ = f"WITH {V.INCIDENCE}"
A_ = f"WITH {V.ACTS}"
X_ = f"WITH {V.XY}, {V.XYC}"
FREQ = f"{I_}, freq AS (SELECT layer, feature_idx, count(DISTINCT run_id) AS frequency, max(v) AS max_v FROM incidence GROUP BY layer, feature_idx), nr AS (SELECT count(DISTINCT run_id) AS n FROM incidence)"
TOP = FREQ + ", top AS (SELECT f.* FROM freq f, nr WHERE frequency <= CAST(floor(nr.n * 0.13) AS BIGINT) ORDER BY frequency DESC, layer, feature_idx LIMIT 20)"


def _top(spark, d, k=20, most=0.13):
    i = V.incidence(spark, d)
    n = i.select("run_id").distinct().count()
    return M.top_features(M.not_ubiquitous(M.feature_frequency(i), n, most), k)


@query("TK1_top_features", TOP + " SELECT layer, feature_idx, frequency, round(max_v, 6) AS max_v FROM top")
def top_features(spark, d):
    return _top(spark, d).withColumn("max_v", F.round("max_v", 6))


@query("AG4_feature_frequency", FREQ + " SELECT layer, feature_idx, frequency, round(max_v, 6) AS max_v FROM freq")
def feature_frequency(spark, d):
    return M.feature_frequency(V.incidence(spark, d)).withColumn("max_v", F.round("max_v", 6))


@query("FLT8_ubiquity", FREQ + " SELECT layer, feature_idx, frequency FROM freq, nr WHERE frequency <= CAST(floor(nr.n * 0.1) AS BIGINT)")
def ubiquity(spark, d):
    i = V.incidence(spark, d)
    return M.not_ubiquitous(M.feature_frequency(i), i.select("run_id").distinct().count(), 0.1).select("layer", "feature_idx", "frequency")


@query("TK2_least_frequent", FREQ + " SELECT layer, feature_idx, frequency FROM freq ORDER BY frequency, layer, feature_idx LIMIT 20")
def least_frequent(spark, d):
    return M.top_features(M.feature_frequency(V.incidence(spark, d)), 20, least=True).select("layer", "feature_idx", "frequency")


for _kind, _value in (("binary", "1.0"), ("influence", "greatest(0, max(v))")):

    @query(f"ML1_feature_matrix_{_kind}", TOP + f" SELECT run_id, layer, feature_idx, round(CAST({_value} AS DOUBLE), 6) AS v FROM incidence JOIN top USING (layer, feature_idx) GROUP BY run_id, layer, feature_idx")
    def feature_matrix(spark, d, kind=_kind):
        return M.feature_matrix(V.incidence(spark, d), 20, kind, 0.13).withColumn("v", F.round("v", 6))


@query("AG5_cell_values", I_ + " SELECT run_id, layer, round(greatest(0, max(v)), 6) AS v, count(*) AS n FROM incidence GROUP BY run_id, layer")
def cell_values(spark, d):
    return V.incidence(spark, d).groupBy("run_id", "layer").agg(F.round(F.greatest(F.lit(0.0), F.max("v")), 6).alias("v"), F.count(F.lit(1)).alias("n"))


@query("AG6_frequency_summary", FREQ + " SELECT round(avg(frequency), 6) AS mean, round(quantile_cont(frequency, 0.5), 6) AS median, round(stddev_pop(frequency), 6) AS std, count(*) AS n_features FROM freq")
def frequency_summary(spark, d):
    s = S.frequency_summary(M.feature_frequency(V.incidence(spark, d)))
    return s.select(*[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "n_features")


CO = TOP + ", m AS (SELECT DISTINCT run_id, layer * 16 + feature_idx AS f FROM incidence JOIN top USING (layer, feature_idx)), co AS (SELECT a.f AS f1, b.f AS f2, count(*) AS n FROM m a JOIN m b ON a.run_id = b.run_id AND a.f < b.f GROUP BY a.f, b.f)"
FLAT = ["f1.layer * 16 + f1.feature_idx AS f1", "f2.layer * 16 + f2.feature_idx AS f2"]


@query("JN8_AG7_cooccurrence", CO + " SELECT f1, f2, n FROM co")
def cooccurrence(spark, d):
    return S.cooccurrence(M.feature_matrix(V.incidence(spark, d), 20, "binary", 0.13)).selectExpr(*FLAT, "n")


PMI = CO + ", nf AS (SELECT f, count(*) AS n FROM m GROUP BY f), p AS (SELECT a.f AS f1, b.f AS f2, coalesce(co.n, 0) AS n, log2((coalesce(co.n, 0) / nr.n + 1e-10) / ((a.n / nr.n) * (b.n / nr.n) + 1e-10)) AS pmi FROM nf a JOIN nf b ON a.f < b.f LEFT JOIN co ON co.f1 = a.f AND co.f2 = b.f, nr)"


def _pmi(spark, d):
    i = V.incidence(spark, d)
    return S.pmi(M.feature_matrix(i, 20, "binary", 0.13), i.select("run_id").distinct().count())


@query("ML4_ML5_pmi", PMI + " SELECT f1, f2, n, round(pmi, 6) AS pmi FROM p")
def pmi(spark, d):
    return _pmi(spark, d).selectExpr(*FLAT, "n", "round(pmi, 6) AS pmi")


@query("TK3_top_pmi_pairs", PMI + " SELECT f1, f2, round(pmi, 6) AS pmi FROM p ORDER BY round(pmi, 6) DESC, f1, f2 LIMIT 10")
def top_pmi(spark, d):
    return _pmi(spark, d).selectExpr(*FLAT, "round(pmi, 6) AS pmi").orderBy(F.desc("pmi"), "f1", "f2").limit(10)


for _which, _sql in (("first", "position = 0"), ("last", "position = last"), (2, "position = 2"), (-2, "position = last - 1")):
    _name = str(_which).replace("-", "minus_")

    @query(f"FLT6_position_{_name}", A_ + f", l AS (SELECT *, max(position) OVER (PARTITION BY run_id) AS last FROM acts) SELECT run_id, position, feature_idx, round(v, 6) AS v FROM l WHERE {_sql}")
    def position(spark, d, which=_which):
        return M.at_position(V.acts(spark, d), which).withColumn("v", F.round("v", 6))


@query("FLT7_in_range", A_ + " SELECT feature_idx, count(*) AS n FROM acts WHERE feature_idx BETWEEN 0 AND 9 GROUP BY feature_idx")
def in_range(spark, d):
    return M.in_range(V.acts(spark, d), 10).groupBy("feature_idx").agg(F.count(F.lit(1)).alias("n"))


@query("JN2_WN4_run_index", A_ + " SELECT run_id, dense_rank() OVER (ORDER BY run_id) - 1 AS row FROM (SELECT DISTINCT run_id FROM acts)")
def run_index(spark, d):
    return M.run_index(V.acts(spark, d))


@query("JN1_WN3_max_position", A_ + " SELECT run_id, max(position) AS last, count(*) AS n FROM acts GROUP BY run_id")
def max_position(spark, d):
    return V.acts(spark, d).groupBy("run_id").agg(F.max("position").alias("last"), F.count(F.lit(1)).alias("n"))


@query("ML2_activation_matrix", A_ + ", l AS (SELECT *, max(position) OVER (PARTITION BY run_id) AS last FROM acts), c AS (SELECT * FROM l WHERE position = last AND feature_idx < 12) SELECT dense_rank() OVER (ORDER BY run_id) - 1 AS row, feature_idx, round(v, 6) AS v FROM c")
def activation_matrix(spark, d):
    return M.activation_matrix(V.acts(spark, d), "last", 12).withColumn("v", F.round("v", 6))


@query("SRC11_layer_scan", I_ + " SELECT run_id, feature_idx, round(v, 6) AS v FROM incidence WHERE layer = 2")
def layer_scan(spark, d):
    return V.incidence(spark, d).where("layer = 2").select("run_id", "feature_idx", F.round("v", 6).alias("v"))


@query("SRC10_incidence_of_runs", I_ + " SELECT run_id, count(*) AS n FROM incidence WHERE label = 3 GROUP BY run_id")
def incidence_of_runs(spark, d):
    i = V.incidence(spark, d)
    wanted = V.xy(spark, d).where("label = 3").select("run_id")
    return i.join(wanted, "run_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


W_ = A_ + ", w AS (SELECT DISTINCT vec_id AS run_id, unnest([0, 1 + vec_id % 4]) AS position FROM embeddings), need AS (SELECT run_id, count(*) AS n FROM w GROUP BY run_id), hit AS (SELECT a.* FROM acts a JOIN w ON a.run_id = w.run_id AND a.position = w.position), ok AS (SELECT h.run_id FROM (SELECT run_id, count(DISTINCT position) AS n FROM hit GROUP BY run_id) h JOIN need USING (run_id, n))"


@query("JN5_JN6_ML3_SRC12_complete_positions", W_ + " SELECT run_id, position, count(*) AS n, round(sum(v), 6) AS total FROM hit WHERE run_id IN (SELECT run_id FROM ok) GROUP BY run_id, position")
def complete_positions(spark, d):
    a = V.acts(spark, d)
    w = V.xy(spark, d).select("run_id", F.explode(F.array(F.lit(0).cast("long"), 1 + F.col("run_id") % 4)).alias("position"))
    return M.at_all_positions(a, w).groupBy("run_id", "position").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query("SNK11_dense_to_coordinates", "SELECT vec_id AS run_id, count(*) AS n, round(sum(v), 6) AS total FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WHERE v <> 0 GROUP BY vec_id")
def dense_to_coordinates(spark, d):
    rows = M.dense_to_coordinates(V.table(spark, d, "embeddings").withColumnRenamed("vec_id", "run_id"), "embedding", "run_id")
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))


def _graphs(spark, d):
    """A compact graph for each run: its features over 0.15."""
    f = F.struct(F.col("layer").cast("int").alias("layer"), (F.col("feature_idx") % 5).cast("int").alias("position"), F.col("feature_idx").cast("int").alias("feature_idx"), F.col("v").alias("influence"), F.col("v").alias("activation_value"), (F.col("v") * 0.8).alias("logit_attribution"))
    return V.incidence(spark, d).groupBy("run_id").agg(F.collect_list(f).alias("features")).withColumn("features", M.checked_features(F.col("features"))).withColumn("input_tokens", F.sequence(F.lit(1), F.lit(5)))


@query("SNK12_graph_features", I_ + " SELECT run_id, layer, count(*) AS n, count(*) FILTER (feature_idx % 5 = 4) AS at_last FROM incidence GROUP BY run_id, layer")
def graph_features(spark, d):
    g = M.graph_features(_graphs(spark, d))
    return g.groupBy("run_id", F.col("layer").cast("long").alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_last_pos"), 1)).alias("at_last"))


@query("TK4_top_by_influence", I_ + " SELECT run_id, feature_idx, layer FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY v DESC, feature_idx) AS k FROM incidence) WHERE k <= 2")
def top_by_influence(spark, d):
    return M.top_by_influence(_graphs(spark, d), 2).select("run_id", F.explode("features").alias("f")).select("run_id", F.col("f.feature_idx").cast("long").alias("feature_idx"), F.col("f.layer").cast("long").alias("layer"))


@query("FLT9_graph_filters", I_ + " SELECT run_id, count(*) FILTER (layer = 1) AS in_layer, count(*) FILTER (feature_idx % 5 = 2) AS at_position FROM incidence GROUP BY run_id")
def graph_filters(spark, d):
    g = _graphs(spark, d)
    return g.select("run_id", F.size(F.filter("features", lambda f: f["layer"] == 1)).cast("long").alias("in_layer"), F.size(F.filter("features", lambda f: f["position"] == 2)).cast("long").alias("at_position"))


#: Edges made of the vectors: a feature is a component over 0.1, of layer p // 16; it passes on to features of the next layer
#: and to three outputs, nodes 64 to 66.
GRAPH = """f AS (SELECT run_id, p AS node, p // 16 AS layer, v FROM (SELECT vec_id AS run_id, unnest(range(len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WHERE v > 0.1),
    o AS (SELECT unnest([64, 65, 66]) AS node, unnest([0.5, 0.3, 0.2]) AS probability),
    e AS (SELECT a.run_id, a.node AS source, b.node AS target, a.v * b.v AS weight FROM f a JOIN f b ON a.run_id = b.run_id AND b.layer = a.layer + 1
          UNION ALL SELECT run_id, f.node, o.node, CASE WHEN (f.node + o.node) % 3 = 0 THEN -v ELSE v * (o.node - 63) END FROM f, o WHERE (f.node + o.node) % 4 > 0),
    s AS (SELECT run_id, source, target, abs(weight) / sum(abs(weight)) OVER (PARTITION BY run_id, target) AS share FROM e),
    i0 AS (SELECT run_id, node, probability AS amount FROM o, (SELECT DISTINCT run_id FROM f)),
    i1 AS (SELECT s.run_id, source AS node, sum(amount * share) AS amount FROM s JOIN i0 ON i0.run_id = s.run_id AND i0.node = target GROUP BY 1, 2),
    i2 AS (SELECT s.run_id, source AS node, sum(amount * share) AS amount FROM s JOIN i1 ON i1.run_id = s.run_id AND i1.node = target GROUP BY 1, 2),
    i3 AS (SELECT s.run_id, source AS node, sum(amount * share) AS amount FROM s JOIN i2 ON i2.run_id = s.run_id AND i2.node = target GROUP BY 1, 2),
    i4 AS (SELECT s.run_id, source AS node, sum(amount * share) AS amount FROM s JOIN i3 ON i3.run_id = s.run_id AND i3.node = target GROUP BY 1, 2),
    n AS (SELECT run_id, node, sum(amount) AS influence FROM (FROM i1 UNION ALL FROM i2 UNION ALL FROM i3 UNION ALL FROM i4) GROUP BY run_id, node)"""


def _graph(spark, d):
    """(edges, logits, features) as GRAPH has them."""
    cells = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("run_id"), F.posexplode("embedding").alias("node", "v")).withColumn("v", F.col("v").cast("double")).where("v > 0.1")
    features = cells.select("run_id", "node", F.expr("node div 16").alias("layer"), F.lit(0).alias("position"), (F.col("node") % 16).alias("feature_idx"), F.col("v").alias("activation"))
    layer = F.expr("node div 16")
    later = cells.select("run_id", F.col("node").alias("target"), F.col("v").alias("w"), (layer - 1).alias("before"))
    between = cells.withColumn("before", layer).join(later, ["run_id", "before"]).select("run_id", F.col("node").alias("source"), "target", (F.col("v") * F.col("w")).alias("weight"))
    target = F.explode(F.sequence(F.lit(64), F.lit(66)))
    both = F.col("node") + F.col("target")
    weight = F.when(both % 3 == 0, -F.col("v")).otherwise(F.col("v") * (F.col("target") - 63))
    out = cells.select("run_id", "node", "v", target.alias("target")).where(both % 4 > 0).select("run_id", F.col("node").alias("source"), "target", weight.alias("weight"))
    outputs = F.explode(F.array(*(F.struct(F.lit(n).alias("node"), F.lit(n * 10).alias("token"), F.lit(p).alias("probability")) for n, p in ((64, 0.5), (65, 0.3), (66, 0.2)))))
    logits = cells.select("run_id").distinct().select("run_id", outputs.alias("o")).select("run_id", "o.*")
    return between.unionByName(out), logits, features


@query("AG25_logit_attribution_of_edges", f"WITH {GRAPH} SELECT run_id, source AS node, round(sum(weight * probability), 6) AS attribution FROM e JOIN o ON o.node = e.target GROUP BY run_id, source")
def logit_attribution_of_edges(spark, d):
    edges, logits, _ = _graph(spark, d)
    return G.logit_attribution(edges, logits).select("run_id", "node", F.round("logit_attribution", 6).alias("attribution"))


@query("FLT10_node_influence", f"WITH {GRAPH} SELECT run_id, node, round(influence, 6) AS influence FROM n")
def node_influence(spark, d):
    edges, logits, _ = _graph(spark, d)
    return G.node_influence(edges, logits, stored).select("run_id", "node", F.round("influence", 6).alias("influence"))


@query("SNK10_FLT10_AG25_compact_graphs", f"""WITH {GRAPH}, c AS (SELECT *, coalesce(sum(influence) OVER (PARTITION BY run_id ORDER BY influence DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(influence) OVER (PARTITION BY run_id) AS whole FROM n),
    k AS (SELECT c.run_id, c.node, influence, coalesce(a.attribution, 0) AS attribution FROM c JOIN f ON f.run_id = c.run_id AND f.node = c.node LEFT JOIN (SELECT run_id, source AS node, sum(weight * probability) AS attribution FROM e JOIN o ON o.node = e.target GROUP BY ALL) a ON a.run_id = c.run_id AND a.node = c.node WHERE before < 0.8 * whole)
    SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(count(*) AS INTEGER) AS n, round(sum(influence), 6) AS influence, round(sum(attribution), 6) AS attribution, CAST(arg_max(node, (influence, -node)) AS INTEGER) AS first FROM k GROUP BY run_id""")
def compact_graphs(spark, d):
    edges, logits, features = _graph(spark, d)
    rows = G.feature_rows(features, G.pruned(G.node_influence(edges, logits, stored), 0.8), G.logit_attribution(edges, logits))
    runs = features.select("run_id").distinct().select("run_id", F.array(F.lit(1)).alias("input_tokens"), F.lit(4).alias("n_layers"), F.lit(42).alias("seed"))
    whole = lambda name: F.round(F.aggregate("features", F.lit(0.0), lambda s, f: s + f[name]), 6)
    first = F.col("features")[0]
    return G.compact(runs, logits, rows).where(F.size("features") > 0).select("run_id", F.size("features").alias("n"), whole("influence").alias("influence"), whole("logit_attribution").alias("attribution"), (first["layer"] * 16 + first["feature_idx"]).alias("first"))


@query("FLT10_prune_by_mask", I_ + " SELECT run_id, sum(layer * 16 + feature_idx)::BIGINT AS kept FROM incidence WHERE (run_id + feature_idx) % 2 = 0 GROUP BY run_id")
def prune_by_mask(spark, d):
    i = V.incidence(spark, d).withColumn("mask", (F.col("run_id") + F.col("feature_idx")) % 2 == 0)
    return i.where("mask").groupBy("run_id").agg(F.sum(F.col("layer") * 16 + F.col("feature_idx")).alias("kept"))


for _how, _sql in (("mean", "SELECT a.run_id, feature_idx, round(sum(v) / any_value(n), 6) AS v FROM acts a JOIN (SELECT run_id, count(DISTINCT position) AS n FROM acts GROUP BY run_id) USING (run_id) GROUP BY a.run_id, feature_idx"), ("max", "SELECT run_id, feature_idx, round(max(v), 6) AS v FROM acts GROUP BY run_id, feature_idx"), ("last", "SELECT run_id, feature_idx, round(v, 6) AS v FROM (SELECT *, max(position) OVER (PARTITION BY run_id) AS last FROM acts) WHERE position = last")):

    @query(f"AG24_sequence_{_how}", f"{A_} {_sql}")
    def sequence(spark, d, how=_how):
        return M.sequence_reduction(V.acts(spark, d), how).withColumn("v", F.round("v", 6))


@query("AG29_sparsity", A_ + " SELECT round(1 - count(*) / (count(DISTINCT run_id) * 64.0)::DOUBLE, 6) AS sparsity FROM acts")
def sparsity(spark, d):
    a = V.acts(spark, d)
    return M.sparsity(a, a.select("run_id").distinct().count(), 64).select(F.round("sparsity", 6).alias("sparsity"))


@query("AG10_cluster_statistics", A_ + ", n AS (SELECT count(DISTINCT run_id) * 16 AS cells, count(DISTINCT run_id) AS r FROM acts WHERE position = 0), c AS (SELECT * FROM acts WHERE position = 0), m AS (SELECT sqrt(sum(pow(s / r, 2))) AS mean_norm FROM (SELECT feature_idx, sum(v) AS s FROM c GROUP BY feature_idx), n) SELECT round(sum(v) / any_value(cells), 6) AS mean, round(sqrt(sum(v * v) / any_value(cells) - pow(sum(v) / any_value(cells), 2)), 6) AS std, round(least(min(v), 0), 6) AS min, round(max(v), 6) AS max, round(any_value(mean_norm), 6) AS mean_norm FROM c, n, m")
def cluster_statistics(spark, d):
    c = M.at_position(V.acts(spark, d), "first")
    s = S.cluster_statistics(c, c.select("run_id").distinct().count(), 16)
    return s.select(*[F.round(x, 6).alias(x) for x in s.columns])


@query("AG11_vector_statistics", X_ + " SELECT label, max(n) AS n, count(*) AS d, round(sqrt(sum(m * m)), 6) AS mean_norm, round(avg(s), 6) AS std FROM (SELECT label, i, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM xyc GROUP BY label, i) GROUP BY label")
def vector_statistics(spark, d):
    s = S.vector_statistics(V.xy(spark, d), "label")
    return s.select("label", "n", "d", F.round("mean_norm", 6).alias("mean_norm"), F.round("std", 6).alias("std"))


@query("AG12_cluster_sizes", X_ + " SELECT label, count(*) AS n FROM xy GROUP BY label")
def cluster_sizes(spark, d):
    return V.xy(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


DIR = X_ + ", cm AS (SELECT i, avg(v) FILTER (y = 0) AS m0, avg(v) FILTER (y = 1) AS m1 FROM xyc GROUP BY i), dn AS (SELECT sqrt(sum(pow(m1 - m0, 2))) + 1e-8 AS norm FROM cm), dir AS (SELECT i, (m1 - m0) / norm AS d FROM cm, dn), pn AS (SELECT sqrt(sum(d * d)) + 1e-8 AS norm FROM dir), proj AS (SELECT run_id, any_value(y) AS y, any_value(dataset_id) AS dataset_id, sum(v * d) / any_value(norm) AS s FROM xyc JOIN dir USING (i), pn GROUP BY run_id)"


@query("AG8_direction", DIR + " SELECT i, round(d, 6) AS d FROM dir")
def direction(spark, d):
    return S.direction(V.xy(spark, d)).select(F.col("i").cast("long").alias("i"), F.round("d", 6).alias("d"))


@query("ML6_projection", DIR + " SELECT run_id, y, round(s, 6) AS s FROM proj")
def projection(spark, d):
    x = V.xy(spark, d)
    return S.projection(x, S.direction(x)).withColumn("s", F.round("s", 6))


@query("AG9_separability", DIR + ", bd AS (SELECT i, avg(v) FILTER (y = 0) AS m0, avg(v) FILTER (y = 1) AS m1, var_samp(v) FILTER (y = 0) AS v0, var_samp(v) FILTER (y = 1) AS v1 FROM xyc GROUP BY i), b AS (SELECT sqrt(sum(pow(m0 - m1, 2))) AS l2, sum(m0 * m1) AS dp, sqrt(sum(m0 * m0)) AS n0, sqrt(sum(m1 * m1)) AS n1, (avg(v0) + avg(v1)) / 2 AS within FROM bd), a AS (SELECT (var_samp(s) FILTER (y = 0) + var_samp(s) FILTER (y = 1)) / 2 AS between_ FROM proj) SELECT round(l2, 6) AS l2, round(dp / (n0 * n1), 6) AS cosine, round(l2 / (n0 + n1 + 1e-8), 6) AS relative, round(within, 6) AS within, round(between_, 6) AS between, round(l2 / sqrt(within), 6) AS l2_within, round(l2 / sqrt(between_), 6) AS l2_between FROM b, a")
def separability(spark, d):
    s = S.separability(V.xy(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("AG31_histogram", DIR + ", e AS (SELECT min(s) AS lo, max(s) AS hi, count(*) AS total FROM proj) SELECT CAST(least(floor((s - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS n, round(count(*) / (any_value(total) * any_value((hi - lo) / 50)), 6) AS density FROM proj, e GROUP BY 1")
def histogram(spark, d):
    x = V.xy(spark, d)
    return S.histogram(S.projection(x, S.direction(x)), "s").withColumn("density", F.round("density", 6))


@query("AG30_centroids", X_ + " SELECT dataset_id, i, round(avg(v), 6) AS m FROM xyc GROUP BY dataset_id, i")
def centroids(spark, d):
    return S.centroids(V.xy(spark, d), "dataset_id").select("dataset_id", F.col("i").cast("long").alias("i"), F.round("m", 6).alias("m"))


@query("ML8_ML21_standardized", X_ + ", s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM xyc GROUP BY i) SELECT run_id, i, round((v - m) / s, 6) AS v FROM xyc JOIN s USING (i)")
def standardized(spark, d):
    return S.standardized(V.xy(spark, d)).select("run_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query("ML21_max_abs", X_ + ", s AS (SELECT i, max(abs(v)) AS s FROM xyc GROUP BY i) SELECT run_id, i, round(v / s, 6) AS v FROM xyc JOIN s USING (i)")
def max_abs(spark, d):
    return S.max_abs_scaled(V.xy(spark, d)).select("run_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query("SC14_ML21_l2_normalized", f"WITH {V.XY} SELECT run_id, round(sqrt(list_dot_product(x, x)), 6) AS norm, round(x[1] / (sqrt(list_dot_product(x, x)) + 1e-8), 6) AS first, round(list_dot_product(x, list_reverse(x)) / (list_dot_product(x, x) + 1e-8), 6) AS cosine FROM xy")
def l2_normalized(spark, d):
    x = V.xy(spark, d)
    return x.select("run_id", F.round(S.norm(F.col("x")), 6).alias("norm"), F.round(S.l2_normalized(F.col("x"))[0], 6).alias("first"), F.round(S.cosine(F.col("x"), F.reverse("x")), 6).alias("cosine"))


NP = f"WITH {V.XY}, {V.XYC}, oncell AS (SELECT run_id, i, y, dataset_id FROM xyc WHERE v > 0.15), t AS (SELECT count(*) AS n, sum(y) AS ny FROM xy), f AS (SELECT i, count(*) AS on_, sum(y) AS hits FROM oncell GROUP BY i), cls AS (SELECT i, on_ / n AS px, CASE WHEN on_ / n > 0.01 THEN log2((hits / n + 1e-10) / ((on_ / n + 1e-10) * (ny / n))) / -log2(hits / n + 1e-10) ELSE 0 END AS npmi FROM f, t), dsz AS (SELECT dataset_id, count(*) AS nd FROM xy GROUP BY dataset_id), ds AS (SELECT i, max(log2((h / n + 1e-10) / ((px + 1e-10) * (nd / n))) / -log2(h / n + 1e-10)) AS dn FROM (SELECT i, dataset_id, count(*) AS h FROM oncell GROUP BY i, dataset_id) JOIN dsz USING (dataset_id) JOIN cls USING (i), t GROUP BY i)"


def _on(spark, d):
    x = V.xy(spark, d)
    return x.select("run_id", F.posexplode("x").alias("i", "v")).where("v > 0.15").select("run_id", F.col("i").cast("long").alias("i")), x.select("run_id", "y", "dataset_id")


@query("ML13_ML15_npmi", NP + " SELECT i, round(px, 6) AS p_x, round(npmi, 6) AS npmi FROM cls")
def npmi(spark, d):
    on, labels = _on(spark, d)
    return S.npmi(on, labels.select("run_id", "y"), 0.01).select("i", F.round("p_x", 6).alias("p_x"), F.round("npmi", 6).alias("npmi"))


@query("ML14_npmi_selection", NP + " SELECT i, round(npmi, 6) AS class_npmi, round(dn, 6) AS dataset_npmi FROM cls JOIN ds USING (i) WHERE px > 0.01 AND npmi > 0.02 AND dn < 0.5")
def npmi_selection(spark, d):
    on, labels = _on(spark, d)
    return S.npmi_selection(on, labels, least_class=0.02).select("i", F.round("class_npmi", 6).alias("class_npmi"), F.round("dataset_npmi", 6).alias("dataset_npmi"))


@query("PRJ2_resolve_positions", "SELECT doc_id, list_aggregate(list_sort(list_distinct([0, n_chars - 1, least(3, n_chars - 1), CASE WHEN n_chars > 1 THEN n_chars - 2 ELSE 0 END])), 'string_agg', ',') AS positions FROM documents")
def resolve_positions(spark, d):
    n = F.col("n_chars").cast("int")
    docs = V.table(spark, d, "documents")
    specs = F.array(F.lit("first"), F.lit("last"), F.least(F.lit(3), n - 1).cast("string"), F.when(n > 1, "-2").otherwise("-1"))
    return docs.select("doc_id", F.array_join(M.resolve_positions(specs, n), ",").alias("positions"))
