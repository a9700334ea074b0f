"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is two joins and an aggregation that combines before its shuffle; a hub's edges
can be split over tasks, since only its minimum is aggregated. Steps are written to the
shared checkpoint folder and repeated until the edges no longer change, which takes a number
of rounds logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _hung(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the least node that can be reached."""
    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _hung(both.where("v > u"), least).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _hung(large, least).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v")
        now = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        if (fresh := _mark(now)) == mark:
            break
        mark = fresh
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
