"""Connected components of a stored edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.functions.cut import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn: each node links its greater neighbours, then its smaller
    ones, to the smallest it knows. The number of rounds grows with the logarithm of the longest path;
    the table never grows. Every step is written to the shared folder, so lineage stays short.
    """
    a, b = F.col("a"), F.col("b")
    edges = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(b.alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(b.alias("a"), F.col("low").alias("b")).filter("a <> b")
        edges = cut(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
