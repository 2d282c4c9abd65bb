"""Connected components of an undirected graph, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import freed, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for all nodes that have an edge.

    Alternating large-star and small-star steps: every node hooks its greater neighbours, then its
    neighbours not greater than itself, to the least of them. Each step is one grouping with partial
    sums (a minimum) and one join; the number of steps grows with the logarithm of the diameter, and no
    node's neighbours are ever gathered. Steps are written to the shared folder.
    """
    pairs = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).where("u <> v").distinct()
    pairs = stored(pairs, "components")
    size = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: greater neighbours of c go to the least node around c
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the nodes themselves keep their own link to that least node
        large = large.unionByName(least.where("c <> m").select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        # small star: lesser neighbours of u, and u, go to the least of them
        lowest = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, F.col("u") == F.col("c"))
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select(F.col("c").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        new = stored(small, "components")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == size:
            freed(pairs)
            out = new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
            out.stored_path = new.stored_path
            return out
        freed(pairs)
        pairs, size = new, now
