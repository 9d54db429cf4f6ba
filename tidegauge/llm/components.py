"""Connected components of an undirected graph, as DataFrame jobs.

Alternating large-star and small-star rounds over an edge table. A round uses
only minimum aggregates and equi-joins, so a hub with a third of all edges is
combined before the shuffle and its join partition can be split; no neighbour
list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import materialise, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node has two parents, or is both a child and a parent: else all edges form stars."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    seen = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return not seen.where("child > 1 or (child = 1 and parent = 1)").isEmpty()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Rows (node, component) for each node with an edge; component is its least node.

    ``edges`` holds two long columns in any direction, repeats and self-loops
    allowed (a node with only self-loops is left out). No edges: no rows. A round
    is written, then its predecessor goes; rounds end when all edges form stars.
    """
    down = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct()
    current = materialise(down, "edges")
    while _unsettled(current):
        following = materialise(_small_star(_large_star(current)), "edges")
        release(current)
        current = following
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
