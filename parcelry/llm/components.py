"""Connected components of a list of links, by alternating stars.

The node in the middle of a star is the key of all its links. What is joined to it is one row a
node, shuffled for the join itself, so that Spark can cut a node with very many links into tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.operators.merge import hash_join
from parcelry.session import Staging


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        hash_join(both.where("b > a"), least, ["a"], "inner")
        .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        .where("a != b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (
        hash_join(down, least, ["a"], "inner")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a != b")
        .union(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for all nodes of links but the roots.

    Each round is written to the shared folder, so the plan stays short and a lost executor
    costs one round at most. The number of rounds grows with the logarithm of the nodes.
    """
    edges = edges.where("a != b").select("a", "b")
    before = None
    while True:
        staged = staging.write(_small_star(staging.write(_large_star(edges)).frame))
        edges = staged.frame
        after = tuple(
            edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        )
        if after == before or not staged.rows:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
