"""Connected components by alternating stars, one stored edge table per round.

A large-star round hangs every larger neighbour of a node on the node's smallest neighbour, a small-star
round does the same with the smaller ones. Both keep the components and end in one star per component
after about log(n) rounds, however long the chains are. A node with very many neighbours meets them in a
join against one row, which adaptive execution splits, and never in one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulon.scale.storage import materialize


def _hang(edges: DataFrame, u: str, v: str) -> DataFrame:
    """``(v, smallest v of u)`` for every edge, and ``(u, that)`` itself."""
    smallest = edges.groupBy(F.col(u).alias("k")).agg(F.min(v).alias("m"))
    met = edges.join(smallest, edges[u] == smallest["k"]).select(F.col(v).alias("a"), F.col("m").alias("b"))
    return met.unionByName(smallest.select(F.col("k").alias("a"), F.col("m").alias("b")))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``(a, b)`` with ``a > b``."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # Only neighbours larger than the node move; the edge (larger, node) becomes (larger, smallest).
    large = edges.join(smallest, edges["b"] == smallest["k"]).select("a", F.col("m").alias("b")).distinct()
    small = _hang(large, "a", "b").where(F.col("a") != F.col("b"))
    return small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: the smallest node that it is connected with.

    Null ends and loops are left out. An empty edge table gives an empty result.
    """
    kept = edges.where(F.col("a") != F.col("b"))
    now = materialize(kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark, last = _mark(now), None
    while mark != last:
        now, last = materialize(_round(now), "links"), mark
        mark = _mark(now)
    rooted = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    # Two edge tables are taken as equal if their sizes and two sums of edge hashes agree.
    wide = "decimal(38,0)"
    sums = [F.sum(F.xxhash64("a", "b", F.lit(s)).cast(wide)) for s in (0, 1)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())
