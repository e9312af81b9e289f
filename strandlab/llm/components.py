"""Connected components of a link table, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.session import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node.

    Each round hangs a node's larger neighbours, then its smaller ones, on the smallest known; chains halve.  A node of
    very many links meets one row, which Spark's skew join splits.  A round is one job, and every round is written, so
    a lost executor repeats no earlier one.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("root")).select("a", F.least("a", "root").alias("root"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).filter("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).union(down.select("a", F.col("root").alias("b")))
        before, edges = edges, cut(small.filter("a != b").distinct())
        drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
