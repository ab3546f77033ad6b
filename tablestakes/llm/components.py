"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node has two links (a, b), or hangs on a node that hangs on another."""
    ends = edges.selectExpr("a AS v", "1 AS below", "0 AS above").unionByName(edges.selectExpr("b AS v", "0 AS below", "1 AS above"))
    sums = ends.groupBy("v").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return sums.where("below > 1 or below = 1 and above = 1").count() > 0


def _star(neighbours: DataFrame, larger_only: bool) -> DataFrame:
    """Links (v, m): every neighbour v of u meets the least node m around u."""
    least = neighbours.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    links = neighbours.join(least, F.col("a") == F.col("u"))
    if larger_only:
        return links.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return links.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the least node.

    `links` is read several times, so it should be written already. Every round is two
    aggregates with map-side combine and two joins on the node, and its links are written
    below the shared folder in place of those before. The rounds end when every node hangs
    on one that hangs on none; their number grows with the logarithm of the longest path.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while _unfinished(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, True).where("a <> b")
        before, edges = edges, cut(_star(large, False).where("a <> b").distinct())
        drop(before)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
