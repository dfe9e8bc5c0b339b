"""Attribution graphs of many runs as tables: influence of nodes, pruning, and the compact graph of each run.

    edges     (run_id, source, target, weight)                 what a node passes on to another
    logits    (run_id, node, token, probability)               the outputs
    features  (run_id, node, layer, position, feature_idx, activation)

Nodes are numbered within a run; those in neither table, such as errors and tokens, have influence and are no features. A
matrix of a run's nodes is never made: products are joins along the edges, of all runs together. Edges given twice add up. A
run without outputs, or a node without a way to them, has no influence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps after which what still goes round in a cycle is left; a graph by layers ends by itself.
MOST_STEPS = 256


def logit_attribution(edges: DataFrame, logits: DataFrame) -> DataFrame:
    """(run_id, node, logit_attribution): what a node passes to the outputs directly, by their probabilities."""
    outputs = logits.select("run_id", F.col("node").alias("target"), "probability")
    return edges.join(outputs, ["run_id", "target"]).groupBy("run_id", F.col("source").alias("node")).agg(F.sum(F.col("weight") * F.col("probability")).alias("logit_attribution"))


def shares(edges: DataFrame) -> DataFrame:
    """(run_id, source, target, share): the share that a source has in the magnitudes of all that a target gets."""
    sums = edges.groupBy("run_id", "source", "target").agg(F.abs(F.sum("weight")).alias("size")).where("size > 0")
    got = sums.groupBy("run_id", "target").agg(F.sum("size").alias("whole"))
    return sums.join(got, ["run_id", "target"]).select("run_id", "source", "target", (F.col("size") / F.col("whole")).alias("share"))


def node_influence(edges: DataFrame, logits: DataFrame, stored) -> DataFrame:
    """(run_id, node, influence): what of the outputs' probabilities comes from a node, over all ways to them.

    Probabilities go back along the edges by their shares, a step at a time, until nothing is left to go back: as many
    steps as the longest way has edges. Each step's table is stored and cuts the lineage.
    """
    back = stored(shares(edges))
    front = logits.groupBy("run_id", "node").agg(F.sum("probability").alias("amount"))
    steps = []
    for _ in range(MOST_STEPS):
        moved = front.withColumnRenamed("node", "target").join(back, ["run_id", "target"])
        front = stored(moved.groupBy("run_id", F.col("source").alias("node")).agg(F.sum(F.col("amount") * F.col("share")).alias("amount")).where("amount > 1e-12"))
        if front.isEmpty():
            break
        steps.append(front)
    if not steps:
        return front.withColumnRenamed("amount", "influence")
    whole = steps[0]
    for step in steps[1:]:
        whole = whole.unionByName(step)
    return whole.groupBy("run_id", "node").agg(F.sum("amount").alias("influence"))


def pruned(influence: DataFrame, share: float = 0.8) -> DataFrame:
    """influence with only the nodes of each run that together have that share of it, the largest first, ties by node: a node is
    kept where those before it have less than the share. A run's nodes are ranked in one task."""
    order = Window.partitionBy("run_id").orderBy(F.desc("influence"), "node").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("influence").over(order), F.lit(0.0))
    whole = F.sum("influence").over(Window.partitionBy("run_id"))
    return influence.withColumn("_before", before).withColumn("_whole", whole).where(F.col("_before") < F.lit(share) * F.col("_whole")).drop("_before", "_whole")


def feature_rows(features: DataFrame, kept: DataFrame, attribution: DataFrame) -> DataFrame:
    """(run_id, layer, position, feature_idx, influence, activation_value, logit_attribution) of the features kept; 0 where
    nothing goes to an output directly."""
    return features.join(kept, ["run_id", "node"]).join(attribution, ["run_id", "node"], "left").select(
        "run_id",
        F.col("layer").cast("int").alias("layer"),
        F.col("position").cast("int").alias("position"),
        F.col("feature_idx").cast("int").alias("feature_idx"),
        F.col("influence").cast("double").alias("influence"),
        F.col("activation").cast("double").alias("activation_value"),
        F.coalesce("logit_attribution", F.lit(0.0)).alias("logit_attribution"),
    )


def compact(runs: DataFrame, logits: DataFrame, rows: DataFrame) -> DataFrame:
    """A graph for each of runs (run_id, input_tokens, n_layers, seed) as storage keeps it: outputs by falling probability,
    features by falling influence, ties by layer, position and index; empty lists where a run has none."""
    falling = lambda by, *parts: F.sort_array(F.collect_list(F.struct((-F.col(by)).alias("_by"), *parts)))
    outputs = logits.groupBy("run_id").agg(falling("probability", "token", "probability").alias("_o"))
    columns = ["layer", "position", "feature_idx", "influence", "activation_value", "logit_attribution"]
    features = rows.groupBy("run_id").agg(falling("influence", *columns).alias("_f"))
    none = lambda column, kind: F.coalesce(column, F.array().cast(kind))
    row = F.transform("_f", lambda f: F.struct(*(f[c].alias(c) for c in columns)))
    kind = "array<struct<layer:int,position:int,feature_idx:int,influence:double,activation_value:double,logit_attribution:double>>"
    joined = runs.join(outputs, "run_id", "left").join(features, "run_id", "left")
    return joined.select(
        F.col("run_id").cast("string").alias("run_id"),
        F.col("input_tokens").cast("array<bigint>").alias("input_tokens"),
        none(F.transform("_o", lambda o: o["token"].cast("bigint")), "array<bigint>").alias("logit_tokens"),
        none(F.transform("_o", lambda o: o["probability"].cast("double")), "array<double>").alias("logit_probabilities"),
        none(row, kind).alias("features"),
        F.col("n_layers").cast("int").alias("n_layers"),
        F.col("seed").cast("bigint").alias("seed"),
    )


def at_position(graphs: DataFrame, position: int) -> DataFrame:
    """graphs with only the features at a position."""
    return graphs.withColumn("features", F.filter("features", lambda f: f["position"] == position))


def top(graphs: DataFrame, k: int) -> DataFrame:
    """graphs with only the k features of most influence."""
    return graphs.withColumn("features", F.slice("features", 1, k))
