"""Digests of table content that merge: versions of regions of labels and of sets of tables, kept up by changes alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the tree below its root, a character of the label each; labels are its leaves beside them.
DEPTH = 12
WORDS = tuple(f"w{i}" for i in range(4))


def _row(columns: list[str]) -> Column:
    """All columns, each with its length in front, so that no two rows read alike; null is none of them."""
    value = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in value])


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in WORDS]
    return rows.groupBy(*keys).agg(F.sum("n").cast("long").alias("n"), *sums)


def leaves(frame: DataFrame, tbl: str, label: str, columns: list[str]) -> DataFrame:
    """(tbl, label, n, words): rows of each label (null: empty) and the sums of their digests' words, in any order of rows."""
    hashed = frame.select(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"), F.sha2(_row(columns), 256).alias("h"))
    words = [F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)").alias(c) for i, c in enumerate(WORDS)]
    return _summed(hashed.select(F.lit(tbl).alias("tbl"), "label", F.lit(1).alias("n"), *words), "tbl", "label")


def tree(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(tbl, leaf, prefix, n, words): leaves, and a node for every prefix of their labels up to a depth, the root's empty."""
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.length("label"), F.lit(depth))), lambda i: F.substring(F.col("label"), F.lit(1), i))
    up = rows.select("tbl", F.lit(False).alias("leaf"), F.explode(prefixes).alias("prefix"), "n", *WORDS)
    return _summed(up, "tbl", "leaf", "prefix").union(rows.select("tbl", F.lit(True), "label", "n", *WORDS))


def change(removed: DataFrame, added: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Entries of a tree that take leaves away and add others: the paths of what changed, and nothing else is read."""
    minus = removed.select("tbl", "label", (-F.col("n")).alias("n"), *[(-F.col(c)).cast("decimal(38,0)").alias(c) for c in WORDS])
    net = _summed(minus.union(added), "tbl", "label").where(reduce(lambda a, c: a | (F.col(c) != 0), WORDS, F.col("n") != 0))
    return tree(net, depth)


def append(entries: DataFrame, folder: str) -> None:
    """Adds entries to a stored tree, in the order of prefixes, so that a region reads few row groups; sums are taken by readers."""
    entries.repartitionByRange("leaf", "prefix").sortWithinPartitions("leaf", "prefix").write.mode("append").parquet(folder)


def compact(stored: DataFrame) -> DataFrame:
    """One entry a node again; nodes that have lost all their rows go."""
    return _summed(stored, "tbl", "leaf", "prefix").where("n <> 0").select("tbl", "leaf", "prefix", "n", *WORDS)


def _digest(n: Column, words: list[Column]) -> Column:
    return F.sha2(F.concat_ws("|", n.cast("string"), *[w.cast("string") for w in words]), 256)


def versions(stored: DataFrame) -> DataFrame:
    """(tbl, prefix, rows, version) of every node."""
    return compact(stored.where("not leaf")).select("tbl", "prefix", F.col("n").alias("rows"), _digest(F.col("n"), [F.col(c) for c in WORDS]).alias("version"))


def _of_tables(sums: DataFrame, name: str) -> DataFrame:
    """(rows, version) over one row a table; their number is the schema's."""
    line = F.concat_ws("=", "tbl", _digest(F.col("n"), [F.col(c) for c in WORDS]))
    return sums.where("n <> 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line)), F.lit(name)), 256).alias("version"))


def region_version(stored: DataFrame, region: str, depth: int = DEPTH) -> DataFrame:
    """(rows, version) of all labels that start with a region: one node a table, or beyond the depth the leaves below one."""
    inside = (~F.col("leaf") & (F.col("prefix") == region)) if len(region) <= depth else (F.col("leaf") & F.col("prefix").startswith(region))
    return _of_tables(_summed(stored.where(inside), "tbl"), region)


def ruleset_version(stored: DataFrame, tables: list[str], algorithm: str) -> DataFrame:
    """(rows, version) of a set of tables, of their roots and the name of the algorithm."""
    return _of_tables(_summed(stored.where(F.col("tbl").isin(tables) & ~F.col("leaf") & (F.col("prefix") == "")), "tbl"), algorithm)
