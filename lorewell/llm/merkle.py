"""A Merkle manifest of a table: leaves, authentication paths, roots and what tampering does to them.

Rows of a group (a language) are ranked by one range-partitioned sort and a table of offsets, and cut into
aligned blocks of 8^4 nodes.  Each block becomes one node, and the nodes of all blocks are ranked, cut and
joined again until a group has one; the groups' own roots are the leaves of one more such tree.
Then paths go down: a block's path above it, of which there is one row a block, meets the block's
nodes, and a traversal emits the path of one node after the other.

The traversal is the fractal one: at each level it keeps the existing subtree, the run of eight
siblings of which the current node's ancestor is one, and the desired subtree, the next run, which grows by as
many nodes as fall due while the current run is used up.  So a block holds two runs a level and
the tails of what grows, never its tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.counts import partitions
from lorewell.session import written

#: Siblings of a run, and levels of a block of FANOUT^LEVELS nodes.
FANOUT, LEVELS = 8, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Side = tuple[str, str]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


class Growing:
    """Nodes of one level above a run of leaves, made as leaves are taken: the tails of the levels below are all it holds."""

    def __init__(self, leaves: list[str], level: int, first: int):
        self.leaves, self.level = leaves, level
        self.next, self.stop = first, min(len(leaves), first + FANOUT ** (level + 1))
        self.tails: list[list[str]] = [[] for _ in range(level)]
        self.run: list[str] = []

    def take(self, n: int) -> None:
        """Takes ``n`` leaves more."""
        for _ in range(min(n, self.stop - self.next)):
            self._add(self.leaves[self.next], 0)
            self.next += 1
        if self.next == self.stop:
            for level, tail in enumerate(self.tails):
                if tail:
                    self.tails[level] = []
                    self._add(digest("".join(tail)), level + 1)

    def _add(self, node: str, level: int) -> None:
        if level == self.level:
            self.run.append(node)
            return
        tail = self.tails[level]
        tail.append(node)
        if len(tail) == FANOUT:
            self.tails[level] = []
            self._add(digest("".join(tail)), level + 1)

    def whole(self) -> list[str]:
        self.take(self.stop - self.next)
        return self.run


def top(leaves: list[str], levels: int) -> str:
    """The node ``levels`` levels above all leaves."""
    if not levels:
        return leaves[0]
    return digest("".join(Growing(leaves, levels - 1, 0).whole()))


def paths(leaves: list[str], levels: int) -> Iterator[list[Side]]:
    """For each leaf in turn, what stands left and right of its ancestor in its run, level by level."""
    existing = [Growing(leaves, level, 0).whole() for level in range(levels)]
    desired = [Growing(leaves, level, FANOUT ** (level + 1)) for level in range(levels)]
    for i in range(len(leaves)):
        for level in range(levels):
            if i and i % FANOUT ** (level + 1) == 0:
                existing[level] = desired[level].whole()
                desired[level] = Growing(leaves, level, i + FANOUT ** (level + 1))
        out = []
        for level, run in enumerate(existing):
            own = i // FANOUT**level % FANOUT
            out.append(("".join(run[:own]), "".join(run[own + 1 :])))
            desired[level].take(1)
        yield out


def fold(node: str, path: list[Side]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def _levels(table: pa.Table, levels: int) -> int:
    return min(levels, height(table["n"][0].as_py()))


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("pos", "ascending")])


def _tops(table: pa.Table, levels: int) -> pa.Table:
    """The node of a block, its place, and how many such nodes its group has."""
    table = _ordered(table)
    first = table.slice(0, 1).to_pylist()[0]
    node = top(table["node"].to_pylist(), _levels(table, levels))
    return pa.Table.from_pylist([{"g": first["g"], "key": first["key"], "pos": first["block"], "n": -(-first["n"] // FANOUT**levels), "node": node}], _NODE)


def _with_paths(table: pa.Table, above: pa.Table, levels: int) -> Iterator[tuple[dict, list[Side]]]:
    """Each row of a block, and its path to the root."""
    table = _ordered(table)
    upper = [(x["left"], x["right"]) for x in above["path"][0].as_py()]
    emitted = paths(table["node"].to_pylist(), _levels(table, levels))
    for part in table.to_batches(max_chunksize=256):
        for row in part.to_pylist():
            yield row, next(emitted) + upper


_NODE = pa.schema([("g", pa.string()), ("key", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())])
_SIDES = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_ABOVE = pa.schema([("g", pa.string()), ("key", pa.string()), ("pos", pa.int64()), ("path", _SIDES), ("subroot", pa.string())])
_PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])
NODE = "g string, key string, pos long, n long, node string"
ABOVE = "g string, key string, pos long, path array<struct<left: string, right: string>>, subroot string"
PROOF = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def _paths(table: pa.Table, above: pa.Table, levels: int) -> pa.Table:
    subroot = above["subroot"][0].as_py()
    rows = [{"g": r["g"], "key": r["key"], "pos": r["pos"], "path": [{"left": a, "right": b} for a, b in p], "subroot": subroot} for r, p in _with_paths(table, above, levels)]
    return pa.Table.from_pylist(rows, _ABOVE)


def _proofs(table: pa.Table, above: pa.Table, levels: int) -> pa.Table:
    subroot = above["subroot"][0].as_py()
    rows = [{"doc_id": r["doc_id"], "leaf": r["node"], "subroot": subroot, "proof_sha256": digest("".join(a + b for a, b in path)), "folded_root": fold(r["tampered"], path)} for r, path in _with_paths(table, above, levels)]
    return pa.Table.from_pylist(rows, _PROOF)


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """The digest of a row's fields, each ``-`` for null or else its length in bytes, a colon and its text."""
    return F.sha2(F.concat(*map(_field, columns)), 256)


def ranked(frame: DataFrame, order: list[str]) -> DataFrame:
    """``frame`` with ``n``, the rows of its group ``g``, and ``pos``, the row's place among them by ``order`` (nulls first).

    One sort by range, and a table of (partition, group) counts whose running sums are the offsets.
    Rows that are equal in ``order`` are dealt by where they were read, so that they need not meet.
    """
    frame = frame.withColumn("_m", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first(c) for c in ("g", *order, "_m")]
    dealt = frame.repartitionByRange(partitions(frame.sparkSession), *keys).sortWithinPartitions(*keys)
    table, _ = written(dealt.withColumn("_m", F.monotonically_increasing_id()))
    table = table.select("*", F.shiftright("_m", 33).alias("_part"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    counts = table.groupBy("g", "_part").agg(F.count("*").alias("_c"), F.min("_place").alias("_first"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")
    counts = counts.select("g", "_part", offset.alias("_offset"), F.sum("_c").over(Window.partitionBy("g")).alias("n"))
    return table.join(counts, ["g", "_part"]).withColumn("pos", F.col("_place") + F.col("_offset")).drop("_m", "_part", "_place", "_offset")


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", (FANOUT**LEVELS).bit_length() - 1))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes, each of the blocks of the one before, until each group has one node."""
    tables, levels = [nodes], LEVELS
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        nodes, _ = written(_blocks(nodes).select("g", "key", "pos", "n", "node", "block").groupBy("g", "block").applyInArrow(lambda table: _tops(table, levels), NODE))
        tables.append(nodes)
    return tables


def _meet(nodes: DataFrame, above: DataFrame, emit, schema: str) -> DataFrame:
    """``emit`` over each block and the path above it."""
    levels = LEVELS
    above = above.select(*[F.col(c).alias("block" if c == "pos" else c) for c in above.columns])  # columns of its own, where both come from one table
    return _blocks(nodes).groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(lambda table, path: emit(table, path, levels), schema)


def descend(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The paths above the blocks of the first table, from those above the nodes of the last."""
    for nodes in tables[-2:0:-1]:
        above = _meet(nodes, above, _paths, ABOVE)
    return above


def manifest(docs: DataFrame, fields: list[str], id: str = "doc_id", group: str = "lang", tampered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf is the digest of ``fields``; the rows of a ``group`` ascend by id.  ``tampered`` gives
    fields that were changed after the manifest was made; ``folded_root`` is recomputed from the
    changed leaf and the original path, and ``verified`` says whether it is the root.

    Cases: a null or empty group is a group of its own, null first; null ids come before others, and rows of
    one id stand by their leaves, so that repeated rows have neighbouring places.  A row alone is
    its group's root, and with no other group the root itself, with an empty proof.  Further
    columns are not looked at; an empty table has an empty result.
    """
    changed = tampered or {}
    nodes = docs.select(
        F.concat(F.col(group).isNotNull().cast("int").cast("string"), F.coalesce(F.col(group).cast("string"), F.lit(""))).alias("g"),
        F.lit("").alias("key"), F.col(id).cast("long").alias("doc_id"),
        leaf(*[F.col(c) for c in fields]).alias("node"), leaf(*[changed.get(c, F.col(c)) for c in fields]).alias("tampered"),
    )
    nodes, _ = written(nodes)
    nodes, _ = written(ranked(nodes, ["doc_id", "node"]))
    groups = climb(nodes)
    subroots = groups[-1].select(F.lit("").alias("g"), F.col("g").alias("key"), "node")
    subroots, _ = written(ranked(subroots, ["key"]))
    whole = climb(subroots)
    root = (whole[-1].select("node").first() or [None])[0]
    start = whole[-1].select("g", "key", "pos", F.array().cast("array<struct<left: string, right: string>>").alias("path"), F.lit(None).cast("string").alias("subroot"))
    of_groups = _meet(subroots, descend(whole, start), _paths, ABOVE).select(F.col("key").alias("g"), "path")
    start = groups[-1].select("g", "key", "pos", F.col("node").alias("subroot")).join(of_groups, "g").select("g", "key", "pos", "path", "subroot")
    out = _meet(nodes, descend(groups, start), _proofs, PROOF)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
