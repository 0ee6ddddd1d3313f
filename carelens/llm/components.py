"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima with map-side combine and two equi-joins
whose skewed keys Spark may split; the edge count never grows. A round's
edges are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import remove, store


def _directed(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Each larger neighbour of a node moves to the node's least neighbour (or itself)."""
    n = _directed(e)
    least = n.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    return n.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    n = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = n.groupBy("a").agg(F.min("b").alias("m"))
    moved = n.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _state(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, label)`` of every node in ``edges (a, b)``; label = least node of its component.

    Null ends and self-links are ignored, repeated links count once; no links
    give an empty table.
    """
    spark = edges.sparkSession
    e, path = store(edges.select("a", "b").filter("a is not null and b is not null and a != b")
                              .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(e)
    while state[0]:
        new, new_path = store(_small_star(_large_star(e).distinct()).distinct(), name)
        new_state = _state(new)
        remove(spark, path)
        e, path = new, new_path
        if new_state == state:
            break
        state = new_state
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
