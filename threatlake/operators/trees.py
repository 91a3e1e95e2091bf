"""Boosted trees as a table of nodes, and scores by following them in plain expressions.

The fitted ensemble is a few hundred small trees, so its nodes fit the driver whatever the data it was fitted on.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.session import ensure_checkpoint_dir


def node_table(model, spark) -> DataFrame:
    """``tree, weight, node, left, right, feature, threshold, prediction`` of a fitted tree ensemble. Leaves have a null
    feature; a row with a value up to the threshold goes left."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees-{uuid4().hex}"
    model.write().save(path)
    weights = spark.createDataFrame(list(enumerate(map(float, model.treeWeights))), "tree int, weight double")
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    return nodes.join(F.broadcast(weights), "tree").select(  # a row per tree
        "tree", "weight", F.col("id").alias("node"), F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"), "prediction",
    )


def margin(nodes: list, feature: Callable[[int], Column]) -> Column:
    """The ensemble's margin: the weighted predictions of the leaves that a row with these features reaches."""
    trees: dict[int, dict] = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.node] = n

    def value(tree: dict, at: int) -> Column:
        n = tree[at]
        if n.feature is None:
            return F.lit(n.weight * n.prediction)
        return F.when(feature(n.feature) <= F.lit(n.threshold), value(tree, n.left)).otherwise(value(tree, n.right))

    total = F.lit(0.0)
    for number in sorted(trees):
        total = total + value(trees[number], 0)
    return total


def probability(total: Column) -> Column:
    """Probability of the positive class, from the margin of boosted trees under logistic loss."""
    return 1 / (1 + F.exp(-2 * total))
