"""Connected components of a graph of links that is larger than one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.sources.staging import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component``: the smallest id that each linked id reaches.

    Two steps take turns until nothing changes: every node hands its larger neighbours to its least neighbour, then its
    smaller ones. The links shrink to stars around the least ids in a few rounds, each written to the shared folder. Only
    minima are grouped, so a node with very many neighbours is no single task's work.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges, before = stage(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    ends = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(ends)
