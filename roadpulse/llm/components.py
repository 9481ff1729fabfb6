"""Connected components by alternating large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import written


def _sign(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest
    node reachable.  Nodes are non-null longs; loops, repeats and both
    directions are allowed.  Each round is written to the shared folder; a
    node's smallest neighbour is a combined aggregate, so a node with very
    many links is never gathered, and the joins on it may be split."""
    e = written(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    now = _sign(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(
            both.filter(F.col("b") > F.col("a")).join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc_large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        e = written(
            joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc_small")
        last, now = now, _sign(e)
        if now == last:
            break
    return (
        e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    )
