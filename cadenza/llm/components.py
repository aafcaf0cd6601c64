"""Connected components of a graph of any size, by alternating star operations.

Each round links every node to the least node it knows of, first its larger
neighbours (large star), then its smaller ones (small star).  Stars, chains and
meshes shrink to stars in a number of rounds that grows with the logarithm of
their diameter.  Minima are combined before the shuffle, and the join on a node of
very high degree may be split by Spark, so no task gathers a node's neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of ``edges(u, v)`` reaches."""
    edges = common.materialize(
        edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "component-edges"
    )
    before = None
    for _ in range(most_rounds):
        near = _both(edges)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = near.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        down = large.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
        last = edges
        edges = common.materialize(small.where(F.col("u") != F.col("v")).distinct(), "component-edges")
        common.discard(last)
        now = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        ).first()
        now = (now["n"], now["s"])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.union(roots.join(stars, "node", "left_anti"))
