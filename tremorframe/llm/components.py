"""Connected components on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorframe.session import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node that is reachable) for undirected ``a, b`` edges of one orderable type.

    Alternating star contractions: a round links each node's larger neighbours to the smallest one, then its
    smaller ones; the number of rounds grows with the logarithm of the longest path. A node's neighbours are only
    ever reduced by ``min`` (combined on the map side), so a hub is no hot group. Self loops and nulls are dropped.
    Each round is written to the checkpoint folder.
    """
    links = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a <> b").distinct())
    while not _settled(links):
        links = durable(_star(_star(links, larger=True), larger=False).distinct())
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component")))


def _settled(links: DataFrame) -> bool:
    """Whether every node points at one other node, and none of these points on."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select(F.col("b"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")) \
        .filter("up > 1 OR up > 0 AND down > 0").isEmpty()


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """``links`` (a > b): connect the larger (or the smaller) neighbours of every node to its smallest neighbour."""
    if larger:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b")
