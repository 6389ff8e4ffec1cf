"""Connected components of an edge table by alternating large-star and small-star steps.

No edge, label or component goes to the driver; each step is two grouped
minima and a join, cut by a written table.  The minima are written
before they are joined, so that the join shuffles both sides and a node with
very many edges can be split among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("x", "y")
    least = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
    return both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.toDF("u", "v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads to a node that has no edge on, and every node has one edge: then it is its root."""
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another node; root is the smallest node that it reaches.

    Edges with a null end and loops are left out; repeated edges count once;
    no edges give no rows.
    """
    real = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(real.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _stars(now):
        now = cut(_small_star(cut(_large_star(now))))
        release(edges.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
