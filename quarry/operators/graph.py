"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.lineage import cut, lookup


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Edges are first rehung so that a node keeps one smaller neighbour. Then each round takes the smallest label among a node's neighbours, then the label of
    that label, and is written to the shared folder. It ends when no label changes.
    Edges with a null end and self-loops are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a <> b")
    e = cut(e.where("a is not null and b is not null").distinct(), "edges")
    # each node's smaller neighbours hang from the least of them: where many edges lead to the same few nodes, few are left
    least = cut(e.groupBy("b").agg(F.min("a").alias("m")), "least")
    e = lookup(e, least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b"))
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = lookup(both, labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = cut(labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("component")), "step")
        # the label of a node's label; labels are nodes themselves
        named = step.select("component").distinct().join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component")
        labels = cut(lookup(step, cut(named, "jump"), "component").select("node", "old", F.col("to").alias("component")), "labels")
        done = labels.where("old <> component").isEmpty()
        labels = labels.select("node", "component")
        if done:
            return labels
