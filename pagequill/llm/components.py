"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequill.llm.staging import discard, stage

EDGES_A_TASK = 500_000


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; root is the smallest node that can be reached.

    Each round works on edges only, with map-side minima, so a hub is never gathered; the number of rounds grows with
    the logarithm of the longest path. Edges with a null end and loops are left out.
    """
    ends = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = stage(ends.where("u > v").distinct())
    while True:
        size = stars.agg(F.count("*"), F.count_distinct("u")).first()
        chained = stars.join(stars.select(F.col("v").alias("u")), "u", "left_semi")
        if size[0] == size[1] and chained.isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
        both = stars.union(stars.select("v", "u"))
        lows = both.groupBy("u").agg(F.min("v").alias("low"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        linked = large.join(lows, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        before = stars
        stars = stage(linked.select("e.u", "e.v").where("u > v").distinct().coalesce(1 + size[0] // EDGES_A_TASK))
        discard(before)
