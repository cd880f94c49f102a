"""Connected components over an edge table, without gathering edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b): component is the smallest node reachable.

    Nodes are of any orderable type without nulls; loops and repeated edges are allowed. Each round points every node
    at its smallest neighbour if that is smaller, follows pointers a few times, and contracts the edges; at least
    half of the nodes that are left vanish in each pair of rounds. Every round ends in a written table.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = None
    edges = edges.select("a", "b").where("a <> b")
    for _ in range(60):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        up = materialize(up, "pointers")
        jump = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
        up = up.join(jump, "p").select("a", F.col("q").alias("p"))
        up = materialize(up.join(jump, "p").select("a", F.col("q").alias("p")), "pointers")
        if labels is None:
            labels = nodes.join(up.select(F.col("a").alias("node"), F.col("p").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        else:
            labels = labels.join(up.select(F.col("a").alias("component"), "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        edges = edges.join(up, "a").select(F.col("p").alias("a"), "b").join(up.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").select("a", F.col("q").alias("b"))
        edges = materialize(edges.where("a <> b").distinct(), "edges")
        labels = materialize(labels, "labels")
        if edges.isEmpty():
            return labels
    raise RuntimeError("no end of rounds")
