"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node of the component.

    Each round takes the least label among a node and its neighbours and then the label's own label, so that
    paths halve; it ends when nothing changes. Labels and edges are tables, so the joins can be split at hubs and
    at labels that many nodes share, and a lost executor costs one round at most. No component is ever gathered.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        lower = materialize(lower, "lower")
        above = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = lower.join(above, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("old")).alias("changed"))
        labels = materialize(moved, "labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
