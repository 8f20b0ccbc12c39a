"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two joins on minima that are summed up before the shuffle, so a node
with very many neighbours is no single task's work. Rounds end when the edges no
longer change, and each round's edges are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    across = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) for every node of ``edges`` (a, b).

    Loops and repeated edges are harmless, edges with a null end are dropped, and
    no edges give no rows.
    """
    edges = checkpointed(edges.filter("a <> b").select("a", "b").distinct())
    state = None
    while True:
        edges = checkpointed(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
