"""Connected components of an undirected graph, by alternating large and small stars.

Nothing but edges is shuffled; each round is stored in the shared folder, so a lost
executor costs one round. Hubs stay edges of their own: minima are aggregated before
the shuffle, and the join that follows can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import common as C


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour that is larger than a node moves to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("m").alias("a"), F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them. Edges have a < b."""
    least = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("m"))
    moved = edges.join(least, F.col("b") == F.col("node")).select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
    return moved.union(least.select(F.col("m").alias("a"), F.col("node").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node that it reaches.

    edges: columns a and b of one orderable type; loops, nulls and repeats don't matter.
    """
    now = C.store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        after = C.store(_small_star(_large_star(now)), "edges")
        C.discard(now)
        now, before, seen = after, seen, mark(after)
        if before == seen:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
