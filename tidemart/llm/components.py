"""Connected components of a graph given as edges, by alternating star contraction.

Each round links every node to the smallest node it knows of, first over larger neighbours, then
over smaller ones; the edges are stored below the shared folder after each round. All steps are
joins and groupings with partial aggregation, so a node with very many neighbours is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemart.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    linked = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"),
                                                          F.col("least").alias("b"))
    return linked.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each smaller neighbour of a node, and the node, to the smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    others = down.join(least, "a").filter("b <> least").select(F.col("b").alias("a"),
                                                               F.col("least").alias("b"))
    return others.union(least.select("a", F.col("least").alias("b"))).distinct()


def _sums(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge (a, b); root is the smallest node of its component."""
    at = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                               F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _sums(at)
    while seen[0]:
        at = written(_small_star(_large_star(at)), "edges")
        before, seen = seen, _sums(at)
        if before == seen:
            break
    members = at.groupBy("a").agg(F.min("b").alias("root"))
    roots = members.select("root").distinct().select(F.col("root").alias("node"), "root")
    return members.select(F.col("a").alias("node"), "root").union(roots)
