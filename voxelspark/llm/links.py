"""Connected components of a link table, without collecting links or groups."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.exchange import cut_lineage


def _smallest(edges: DataFrame) -> DataFrame:
    """``u, m``: the smallest of each node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``links(u, v)``: the smallest node reachable.

    Large-star and small-star steps alternate until the links no longer change. Both are a
    minimum per node (combined before the shuffle) and a join, so a node with very many
    links is never gathered in one task."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    edges, before = cut_lineage(edges), None
    while True:
        # large star: greater neighbours point to the smallest
        low = _smallest(edges)
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("far")).join(low, "u").select(F.col("far").alias("u"), F.col("m").alias("v"))
        own = edges.join(low, "u").select("u", F.col("m").alias("v"))
        edges = large.unionByName(own).filter("u > v").distinct()
        # small star: smaller neighbours and the node itself point to the smallest
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        edges = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
