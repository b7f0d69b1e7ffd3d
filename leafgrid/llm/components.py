"""Connected components by alternating large and small stars, entirely as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, materialise


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are stars: each upper node has one lower node, which is no upper node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter("up + low > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for links(a, b) between numbers.

    Links with a null end are ignored; no links give no rows; repeated links count once.

    Each round ties every node to the smallest node around it; rounds end when only stars are left,
    after about the logarithm of the longest chain.  Minima are taken with map-side combine, so a
    node with very many links is no hot spot.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        after = materialise(small.distinct(), "edges")
        forget(edges)
        edges = after
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = materialise(out, "roots")
    forget(edges)
    return out


def forest_roots(links: DataFrame) -> DataFrame:
    """node, root for links(a, b) in which each b has one smaller a: every node takes its root's root until none moves."""
    now = materialise(links.select(F.col("b").alias("node"), F.col("a").alias("root"), F.lit(True).alias("moved")), "forest")
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = materialise(now.join(above, "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "forest")
        forget(now)
        now = after
        if now.filter("moved").isEmpty():
            tops = now.select(F.col("root").alias("node"), "root").distinct()
            out = materialise(now.select("node", "root").unionByName(tops), "roots")
            forget(now)
            return out


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root of what roots and further links connect: the links are drawn between roots first."""
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    upper = components(between)
    named = roots.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = upper.join(roots.select("node"), "node", "left_anti").select("node", "root")
    out = materialise(named.unionByName(alone), "roots")
    forget(upper)
    return out
