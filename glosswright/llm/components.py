"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.session import written


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, to a root."""
    ends = edges.selectExpr("a AS node", "1 AS up", "0 AS down").unionByName(edges.selectExpr("b AS node", "0 AS up", "1 AS down"))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 OR up = 1 AND down = 1").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``, of one ordered type); ``root`` is the smallest node of its component.

    Each round joins edges with the least neighbour of each node, a partial aggregate, so that a node with very many neighbours is no single
    task's work. Rounds grow with the logarithm of the longest path; edges from nodes to their roots need none. Loops and repeated edges don't matter; an empty table gives no nodes.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "node")
        small = large.join(low, F.col("a") == F.col("node"))
        small = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct()
        edges = written(small, "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
