"""Connected components by alternating large-star and small-star, with min-id labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch


def _meet(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the row of ``least`` of their u.

    The keys are u and its hash, so both sides are dealt anew and neither is tied to the aggregation
    by u: adaptive execution can then split the edges of a hub over tasks.
    """
    hashed = F.xxhash64("u")
    return edges.withColumn("k", hashed).join(least.withColumn("k", hashed), ["k", "u"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _meet(both, least).where(F.col("v") > F.col("u")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _meet(edges, least).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) long edges -> (node, component): component is the smallest node reachable.

    Nodes without an edge to another node do not appear. Loops, repeated edges and null ends are
    dropped. Each half-step is one aggregation and one join: a node with a third of all edges is
    pre-aggregated before the shuffle, and its edges in the join may be split over tasks. Lineage is
    cut by a written table every round; nothing is collected but a count and a checksum.
    """
    now = scratch.save(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == before or not state["n"]:
            break
        before = state
        after = scratch.save(_small_star(_large_star(now)))
        scratch.free(now)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
