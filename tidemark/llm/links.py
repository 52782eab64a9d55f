"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node it reaches.

    Each round ties every node's larger neighbours to its smallest one (large star), then every
    node's smaller neighbours (small star); it ends when nothing changes, after a number of rounds
    that grows with the logarithm of the nodes. Nothing but counts comes to the driver. The result is
    read from a table in the checkpoint folder; those of the rounds are deleted."""
    scratch, turn = Scratch(links.sparkSession, "components"), 0
    edges = scratch.put("0", links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark or not now["n"]:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.put(f"{turn}-large", large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.put(f"{turn + 1}", near.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(f"{turn}", f"{turn}-large")
        turn += 1
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
    out = scratch.put("nodes", nodes.groupBy("node").agg(F.min("component").alias("component")))
    scratch.drop(f"{turn}")
    return out
