"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.functions.frames import union_all
from pickwell.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of edges ``a, b``; the component is its smallest node.

    Alternates two steps until every node points to the smallest of its component and that to none: every node points its larger
    neighbours, then its smaller ones, to the smallest node near it. Each halves distances, so rounds grow with the logarithm
    of the longest path, and edges that are stars already need none. Minima are partial before each shuffle, so a hub is no hot
    group; each round is written to the shared folder.
    """
    both = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held = stored(both, "edges")
    while not _settled(held):
        held = stored(_small_step(_large_step(held)), "edges")
    roots = held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return union_all(held.select(F.col("a").alias("node"), F.col("b").alias("component")), roots)


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none of its own."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    tops = edges.select(F.col("a").alias("top"))
    return edges.join(tops, F.col("b") == F.col("top"), "left_semi").isEmpty()


def _large_step(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node, pointed to the smallest of it and its neighbours."""
    around = union_all(edges, edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (
        around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    )


def _small_step(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, pointed to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return union_all(moved, least.select("a", F.col("least").alias("b"))).distinct()
