"""Connected components of a large edge table by repeated star contraction.

Each round links every vertex to the smallest vertex it knows of (the
large-star and small-star steps); edges, links and components stay in
DataFrames, and every round is a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    joined = down.join(least, "a")
    return (
        joined.where("b <> least")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .union(least.select("a", F.col("least").alias("b")))
        .distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; both steps leave only stars unchanged."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, root): root is the smallest reachable node.

    Only nodes with an edge to another node appear.  Self loops and repeated
    edges are harmless; an empty table gives an empty table.
    """
    edges = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = _digest(edges)
    while True:
        again = staged(_small_star(_large_star(edges)), "edges")
        now = _digest(again)
        if now == before:
            break
        edges, before = again, now
    return again.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        again.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
