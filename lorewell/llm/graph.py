"""Connected components of an edge table, and what the operators share about tables of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.session import saved

__all__ = ["BROADCAST_ROWS", "components", "fresh", "hinted", "saved"]

#: Rows up to which a (saved) table of ids is broadcast (tens of bytes each); beyond, it is shuffled.
BROADCAST_ROWS = 2_000_000
#: Bytes of wide columns up to which they go along.
BROADCAST_BYTES = 64_000_000


def hinted(frame: DataFrame, width: Column | None = None) -> DataFrame:
    """A saved table of ids, to be broadcast behind a count of its rows (and of the bytes of its wide columns), or else joined by hash."""
    rows, size = frame.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0)) if width is not None else F.lit(0)).first()
    return F.broadcast(frame) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else frame.hint("shuffle_hash")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column of a caller's table has, whatever its case."""
    out, used = [], {c.lower() for c in taken}
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Each round takes the smallest label among a node's neighbours, then the label of
    that label, so that a star is done in one round and a chain in about its logarithm;
    rounds go on until no label changes.  Labels are pre-aggregated before each shuffle; a
    node of many edges costs a row a task.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = saved(pairs.union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = saved(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "c"), "y").groupBy("x").agg(F.min("c").alias("m"))
        step = labels.join(near, "x").select("x", F.least("c", "m").alias("m"), F.col("c").alias("was"))
        jump = step.join(labels.select(F.col("x").alias("m"), F.col("c").alias("j")), "m", "left")
        new = saved(jump.select("x", F.least("m", F.coalesce("j", "m")).alias("c"), "was"))
        if not new.where("c <> was").limit(1).count():
            return new.select(F.col("x").alias("node"), F.col("c").alias("component"))
        labels = new.select("x", "c")
