"""Connected components of an edge table by alternating large-star and small-star rounds, all joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over (a, b): each node's neighbours (large: those above it, small: those below) are tied to its least neighbour or itself."""
    if large:
        around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b")


def _settled(edges: DataFrame) -> bool:
    """Whether each node above has one link, to a node that has none itself."""
    ups = edges.groupBy("a").agg(F.count("*").alias("n"), F.lit(0).alias("as_b"))
    downs = edges.select(F.col("b").alias("a"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("as_b")).distinct()
    both = ups.unionByName(downs).groupBy("a").agg(F.sum("n").alias("n"), F.max("as_b").alias("as_b"))
    return not both.where("n > 1 OR (n = 1 AND as_b = 1)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that its links reach) for every node of ``edges`` (a, b); loops and repeats may occur.

    Each pair of rounds is stored; the number of rounds grows with the logarithm of the longest path. No task sees a
    whole component: nodes with many links are summed up before the shuffle and joined in parts.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    while True:
        now = stored(_star(_star(now, True), False).distinct())
        if _settled(now):
            break
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
