"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.storage import written


def _smaller_ends(edges: DataFrame) -> DataFrame:
    """Every edge with the smallest neighbour of its centre.

    The minima are summed before they are shuffled and written before the join, which can then split a centre of any degree.
    """
    return edges.join(written(edges.groupBy("a").agg(F.min("b").alias("least")), "least"), "a")


def _is_star_forest(pairs: DataFrame) -> bool:
    """Every node hangs on to one root, and no root hangs on to anything."""
    several = pairs.groupBy("a").count().filter("count > 1").select("a")
    inner = pairs.select(F.col("b").alias("a")).join(pairs.select("a"), "a", "left_semi")
    return several.union(inner).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge to another one; ``root`` is the smallest node it reaches.

    Loops and repeated edges do not matter, edges with a null end are left out. Every round is written to the shared folder.
    """
    pairs = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = written(pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    while not _is_star_forest(pairs):
        # Large star: every larger neighbour of a node hangs on to its smallest one.
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _smaller_ends(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        # Small star: a node and its smaller neighbours hang on to the smallest of them.
        low = _smaller_ends(large)
        small = low.select(F.col("b").alias("a"), F.col("least").alias("b")).union(low.select("a", F.col("least").alias("b")))
        pairs = written(small.filter("a <> b").distinct(), "edges")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
