"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetledger.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node that links ``x``, ``y`` name.

    Each round points every node to its smallest neighbour, follows the pointers twice and
    contracts the links; what is left has far fewer nodes, so rounds grow with the
    logarithm of the longest chain. Every round is written and read again.
    """
    pair = links.where("x <> y")
    edges = store(pair.select("x", "y").union(pair.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        up = edges.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("node"), F.least("x", "low").alias("up"))
        up = store(up, "pointers")
        for _ in range(2):
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(above, "up").select("node", F.col("top").alias("up"))
        up = store(up, "pointers")
        if labels is None:
            labels = up.withColumnRenamed("up", "component")
        else:
            moved = up.select(F.col("node").alias("component"), F.col("up").alias("to"))
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = store(labels, "labels")
        left = up.select(F.col("node").alias("x"), F.col("up").alias("x_up"))
        right = up.select(F.col("node").alias("y"), F.col("up").alias("y_up"))
        edges = edges.join(left, "x").join(right, "y").where("x_up <> y_up")
        edges = store(edges.select(F.col("x_up").alias("x"), F.col("y_up").alias("y")).distinct(), "links")
    if labels is None:
        return links.select(F.col("x").alias("node"), F.col("y").alias("component")).where(F.lit(False))
    return labels
