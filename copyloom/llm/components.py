"""Connected components of a table of links, by large and small stars (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs a node's neighbours on the smallest of them: the larger ones, or the smaller ones and the node itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        own = least.select("a", F.col("least").alias("b"))
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own)
    return out.where("a != b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """node, component: for every node of `links` (a, b: long) the smallest node that it is linked to, directly or not.

    Links are tables throughout; each round is written to the shared folder. The number of rounds grows with the logarithm
    of the longest chain.
    """
    edges = cut(links.select("a", "b").where("a != b").distinct())
    state = _state(edges)
    while state[0]:
        edges = cut(_star(_star(edges, large=True), large=False))
        new = _state(edges)
        if new == state:
            break
        state = new
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
