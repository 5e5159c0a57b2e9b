"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trustweave.llm.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to rows (node, root): each node that isn't its component's smallest.

    Alternates two steps that only ever re-hang edges on a smaller neighbour, so their
    number doesn't grow and a hub with millions of edges is never gathered: its minimum is
    a partial aggregate, and its edges are joined with that one value. Ends when a round
    changes nothing, after about the logarithm of the longest path.
    """
    kept = staged(_oriented(edges), "edges")
    mark = _mark(kept)
    while True:
        kept = staged(_small_star(_large_star(kept)), "edges")
        new = _mark(kept)
        if new == mark:
            return kept.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _oriented(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(hung.unionByName(least.select("a", F.col("m").alias("b"))))
