"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in the links (a, b); a component is named by its smallest node.

    Alternates two steps until nothing changes: every node tells its larger neighbours, then its smaller
    ones, about the smallest node it knows. The number of rounds grows with the logarithm of the number of
    nodes. Minima are pre-aggregated and joined back, so a node with many links is no group of its own.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = store(edges.distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        told = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = told.where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        told = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = told.unionByName(lowest.withColumnRenamed("m", "v")).where("u != v").distinct()
        edges = store(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
