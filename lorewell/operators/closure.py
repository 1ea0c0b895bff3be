"""Merges that close over chains: components of merge decisions, and the node that each ends at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.session import saved


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))


def _checksum(edges: DataFrame) -> tuple:
    """Rows of an edge set and a sum over them that does not depend on their order."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches, by alternating stars.

    A large star hangs each node's larger neighbours on its smallest one, a small star its smaller ones and
    itself; edges never grow in number, and after some rounds, about the logarithm of the longest path,
    all are stars.  Minima are summed up before they are shuffled, and a node of many edges is
    joined back to them, which Spark can split.
    """
    # x > y from here on
    now = saved(edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x <> y").distinct())
    was = None
    while (is_now := _checksum(now)) != was:
        was = is_now
        both = _both(now)
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = saved(large.where("x <> y").distinct())
        least = now.groupBy("x").agg(F.min("y").alias("m"))
        hung = now.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y")))
        now = saved(hung.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    roots = now.select("y").distinct()
    return now.select(F.col("x").alias("node"), F.col("y").alias("component")).union(roots.select("y", "y"))


def settle(merged: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """(loser, survivor): where every loser of some merges (loser, survivor) ends, through chains and cycles.

    Of all nodes that merges connect one survives: one that never loses before others, then the one of
    most ``support`` (id, n_support), then the smallest.  Merges of a node with itself, and null ends, count for nothing.
    """
    pairs = saved(merged.select("loser", "survivor").where("loser <> survivor").distinct())
    groups = components(pairs, "loser", "survivor")
    lost = pairs.select(F.col("loser").alias("node"), F.lit(1).alias("lost")).distinct()
    rows = groups.join(lost, "node", "left")
    if support is not None:
        rows = rows.join(support.select(F.col("id").alias("node"), "n_support").groupBy("node").agg(F.max("n_support").alias("n_support")), "node", "left")
    else:
        rows = rows.withColumn("n_support", F.lit(0))
    best = F.min(F.struct(F.coalesce("lost", F.lit(0)).alias("lost"), (-F.coalesce("n_support", F.lit(0))).alias("n"), F.col("node").alias("survivor")))
    chosen = rows.groupBy("component").agg(best.alias("best")).select("component", "best.survivor")
    return groups.join(chosen, "component").where("node <> survivor").select(F.col("node").alias("loser"), "survivor")


def resolved_merges(decided: DataFrame, nodes: DataFrame) -> DataFrame:
    """(loser, survivor) of a resolved queue (a, b, decision): all nodes that ``same`` connects, merged into the live one of most support."""
    pairs = decided.where("decision = 'same'").select(F.greatest("a", "b").alias("loser"), F.least("a", "b").alias("survivor"))
    both = pairs.union(pairs.select(F.col("survivor").alias("loser"), F.col("loser").alias("survivor")))  # none is sure to survive
    return settle(both, nodes.where("status = 'active'"))
