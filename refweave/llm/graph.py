"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from refweave.llm.common import written
from refweave.operators.joins import join_unique


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; ``root`` is the smallest node reachable.

    Alternating star contractions: every node first links its larger neighbours, then
    its smaller ones, to the smallest node it knows.  Minima are aggregated map-side and
    joined back, so a hub is split like any hot key.  Each round is written to the
    shared folder.  Ends when a round changes nothing, after O(log^2 n) rounds.
    """
    edges = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (
            join_unique(both.where("b > a"), least, ["a"])
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a != b")
            .distinct()
        )
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_unique(large, least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(
            small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "edges"
        )
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
