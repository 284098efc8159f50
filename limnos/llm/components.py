"""Connected components of a graph of long ids, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import materialize


def _shortcut(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by its root: paths halve in
    each round."""
    while True:
        up = parents.select(F.col("node").alias("__at"), F.col("parent").alias("__up"))
        step = parents.join(up, parents["parent"] == up["__at"], "left")
        step = materialize(step.select("node", F.coalesce("__up", "parent").alias("parent"), F.col("__up").isNotNull().alias("moved")), "parents")
        parents = step.select("node", "parent")
        if step.filter("moved").isEmpty():
            return parents


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least id reachable, for every node with an edge.
    ``edges`` has columns a and b; direction, repeats and loops don't matter.

    Each round hangs every node below its least smaller neighbour (a partial
    aggregate, so a hub is no single task's), follows parents to their roots
    and keeps the edges between different roots. At most half of the nodes
    stay, so there are few rounds.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges, labels = materialize(tidy(edges), "edges"), None
    while not edges.isEmpty():
        roots = _shortcut(materialize(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents"))
        if labels is None:
            least = edges.select(F.col("a").alias("node")).distinct().join(roots, "node", "left_anti")
            labels = roots.unionByName(least.select("node", F.col("node").alias("parent")))
        else:
            new = roots.select(F.col("node").alias("__at"), F.col("parent").alias("__up"))
            labels = labels.join(new, labels["parent"] == new["__at"], "left").select("node", F.coalesce("__up", "parent").alias("parent"))
        labels = materialize(labels, "labels")
        left = roots.select(F.col("node").alias("a"), F.col("parent").alias("__a"))
        right = roots.select(F.col("node").alias("b"), F.col("parent").alias("__b"))
        moved = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b"))
        edges = materialize(tidy(moved), "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("parent"))
    return labels.select("node", F.col("parent").alias("component"))
