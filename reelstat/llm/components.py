"""Connected components of a graph given as a table of links, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long, either way round, loops allowed) to node, root:
    the smallest node that each node of a link reaches.

    Alternating star contraction: every node hands its larger neighbours to its
    smallest one (large star), then each node's smaller neighbours and itself
    are tied to the smallest of them (small star).  Links never grow in number
    and the rounds needed grow with the logarithm of the longest path.  Minima
    are combined map-side; each round is a written table, so a lost executor
    repeats one round at most.  A round that changes nothing ends it.
    """
    def undirected(table: DataFrame) -> DataFrame:
        return table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def least(table: DataFrame) -> DataFrame:
        return written(table.groupBy("a").agg(F.min("b").alias("low")), "low")

    def digest(table: DataFrame) -> tuple:
        row = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = written(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (state := digest(now)) != before:
        before = state
        # large star: a's neighbours above a are tied to the least of a and its neighbours
        both = undirected(now)
        large = (both.join(least(both), "a")
                     .filter("b > a")
                     .select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
                     .filter("a <> b").distinct())
        large = written(large, "large")
        # small star: the neighbours below a, and a, are tied to the least of them
        small = large.join(least(large), "a")
        now = written(small.select(F.col("b").alias("a"), F.col("low").alias("b"))
                           .unionByName(small.select("a", F.col("low").alias("b")))
                           .filter("a <> b").distinct(), "links")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
