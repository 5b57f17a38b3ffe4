"""Connected components of an edge table by alternating star contraction.

Each round is two joins and two grouped minima over the edges, checkpointed to the shared folder. A node with very
many neighbours is a skewed join key only (the other side has one row per node), which adaptive execution splits;
grouped minima combine before the shuffle. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.runtime import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` that is not itself the smallest of its component.

    Self loops and rows with a null end are ignored; repeated and reversed edges count once.
    """
    edges = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("ok"))
        .where("ok and a <> b")
        .select("a", "b")
        .distinct()
    )
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        edges = cut(_small_star(_large_star(edges)))
