"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.plans.lineage import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node on an edge, the smallest node it can reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step replaces the edges of a
    node by edges to the smallest node seen, so a chain's length falls geometrically and a hub's edges
    stay one row each. Both steps aggregate by node (partially, before the shuffle); no list of
    neighbours is ever built. The edges of every round are checkpointed. Null ends and loops are dropped.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = cut(pairs)
    before = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("w", "m").alias("m"))
        # large star: every larger neighbour of a node goes to the smallest node around it
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u <> v").distinct())
        # a fingerprint of the edge set: two rounds alike mean stars only
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
