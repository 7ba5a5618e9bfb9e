"""Connected components of an edge table by alternating stars; state lies in written tables, nothing is gathered on the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of edges (a, b) with the smallest node of its component.

    Each round links the larger neighbours of a node to its smallest neighbour, then the smaller ones; a node's neighbours are rows, so a
    node with very many is many tasks' work. The edges end as stars around the roots. Loops and repeated edges do not matter.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = smallest(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "stars")
        seen = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
