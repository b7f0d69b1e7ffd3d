"""Connected components within groups, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settle


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str) -> DataFrame:
    """nodes(keys, node) with root: the smallest node that edges(keys, a, b) reach from it.

    Every round gives each node the smallest root around it and then its root's root, so chains
    halve and rounds follow the logarithm of the longest chain.  Neither a group nor a node's edges
    meet in one task: minima are taken with map-side combine.  Edges between nodes that aren't there
    are ignored.
    """
    keys = list(keys)
    both = settle(edges.filter("a <> b").select(*keys, "a", "b").unionByName(edges.filter("a <> b").select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = settle(nodes.select(*keys, F.col(node).alias("v"), F.col(node).alias("root")))
    while True:
        near = both.join(now.withColumnRenamed("v", "a"), [*keys, "a"]).groupBy(*keys, F.col("b").alias("v")).agg(F.min("root").alias("near"))
        least = now.join(near, [*keys, "v"], "left").select(*keys, "v", F.least("root", "near").alias("root"), F.col("root").alias("before"))
        above = least.select(*keys, F.col("v").alias("root"), F.col("root").alias("far"))
        after = settle(least.join(above, [*keys, "root"]).select(*keys, "v", F.least("root", "far").alias("root"), "before"))
        if after.filter("root <> before").isEmpty():
            return after.select(*keys, F.col("v").alias(node), "root")
        now = after.select(*keys, "v", "root")
