"""Connected components of an edge table, by alternating stars: no node's neighbours are gathered, no edge leaves Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.sources.workspace import materialise


def _to_least(e: DataFrame) -> DataFrame:
    """Large star, then small star: every neighbour of u, then u itself, is tied to the least node about u."""
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = large.distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
    return small.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of (a, b): label is the least node that can be reached.

    Null ends and loops are left out; repeated edges count once; no edges give an empty table.
    """
    e = materialise(_to_least(edges.where("a != b").select("a", "b")), "edges")
    while not e.select("a").join(e.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() or not e.groupBy("a").count().where("count > 1").isEmpty():
        e = materialise(_to_least(e), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
