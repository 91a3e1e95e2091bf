"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threatlake.llm.common import stored


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; the component is the smallest node that can be reached.
    ``labels`` are the components of earlier edges, which the new edges join further.

    Each round links every node to its smallest neighbour, follows the links once more, and replaces the edges by the
    distinct edges between what the nodes are linked to; the rounds end when none are left. The smallest node of a
    component is linked to itself in all rounds, so its name is the one that remains. All state is in tables of the shared
    folder, all steps are equi-joins on a unique key and pre-aggregated minima."""
    if labels is None:
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        labels = nodes.select("node", F.col("node").alias("component"))
    else:
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        fresh = nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
        labels = stored(labels.union(fresh), "labels")
        edges = _renamed(edges, labels.select("node", F.col("component").alias("parent")))
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        linked = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("parent"))
        above = linked.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        parents = stored(linked.join(above, "parent").select("node", F.col("_up").alias("parent")), "parents")
        step = parents.select(F.col("node").alias("component"), "parent")
        labels = labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        edges = stored(_renamed(edges, parents), "edges")
    return stored(labels, "labels")


def _renamed(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct edges between the parents of both ends."""
    a = parents.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
    b = parents.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
    rest = edges.join(a, "a").join(b, "b").where("_a <> _b")
    return rest.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
