"""Connected components as DataFrame joins: alternating large-star and small-star rounds, each cut by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifcast.llm.common import bounded_broadcast, checkpointed


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    """Each node sends its larger neighbours to the smallest node of its neighbourhood."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(bounded_broadcast(least, 2 * rows), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    """Each node sends its smaller neighbours, and itself, to the smallest of them. Edges point down: u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(bounded_broadcast(least, 2 * rows), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between ids of any ordered type -> (node, component): for each node that has a link to another, the smallest id it reaches.

    Self-links and repeated links do not matter; null ends are dropped; no links give an empty table. A node with very many
    links is a large group only of map-side minima and of joins that adaptive execution splits. The number of rounds is
    logarithmic in practice (squared logarithm at most). Few links (a counted bound) are joined by a broadcast.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpointed(e)
    before, now = None, _state(e)
    while now != before:
        e = checkpointed(_small_star(_large_star(e, now[0]), now[0]))
        before, now = now, _state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
