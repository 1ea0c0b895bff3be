"""Similarity join of documents on word shingles, by token-combination prefixes.

Two documents link when their sets of n-word shingles have a Jaccard similarity of
``percent`` / 100 at least.  The plan:

1. Documents with equal sets form a class; one of them stands for it from here on.
2. The corpus-wide document frequency of each shingle orders the shingles, rare first
   (:mod:`lorewell.llm.counts`).
3. Each document's prefix is extended until its uncovered cost reaches
   ``p = n - ceil(percent * n / 100) + 1``.  A shingle of one document costs 1 and needs
   no index entry; a rare one (up to ``rare`` documents) costs 1 and is indexed alone;
   frequent ones are dealt by hash into sub-classes, in each of which all but the first
   cost 1, and their pairs are indexed.  Linked documents share an index entry: if they
   shared none, their prefixes would differ in p shingles at least.  Entries carry a
   size class, and lengths within the threshold meet in a common one.
4. In each entry the document with the fewest shingles of its own is the hub, and every
   member is verified against it.  What a member lacks of its hub and has beyond it is
   kept: |x & y| = |h| - |lacks x or y| + |beyond in both| verifies any two members of a
   hub without their texts.  Where links to the hubs leave members of a hub in different
   components, those outside its largest one are verified with all others, in blocks.  So
   no link between components is left out, and no pairs of a group are made as rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import counts, spans
from lorewell.llm.graph import components, hinted, saved

#: Up to so many documents, a shingle is rare.
RARE = 16
#: Prefix shingles that a sub-class of frequent shingles has, about.
SUBCLASS = 4
#: Members of a block of a hub (more for large ones, so that copies of rows grow with the root of its size).
BLOCK = 128
#: Pairs of texts whose sets are held at once.
VERIFIED = 256
_U = np.uint64


def set_key(s: np.ndarray) -> bytes:
    """128 bits that stand for a set of hashes (sorted, distinct)."""
    with np.errstate(over="ignore"):
        a, b = spans.mix(s), spans.mix(s ^ _U(0x5851F42D4C957F2D))
        return np.array([a.sum(dtype=_U) + _U(len(s)), b.sum(dtype=_U)], "<u8").tobytes()


def _keys(n: int):
    def run(batches):
        for batch in batches:
            found = [(len(s), set_key(s)) for s in spans.shingle_sets(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([size for size, _ in found], pa.int64()), pa.array([key for _, key in found], pa.binary())],
                names=["doc_id", "n_shingles", "key"],
            )

    return run


def _representatives(table: pa.Table, ids: pa.Table, n: int) -> list[tuple[int, np.ndarray]]:
    """(document, set) of a batch's representatives, each class once, in order of class."""
    wanted = set(zip(ids["doc_id"].to_pylist(), ids["key"].to_pylist(), strict=True))
    mine = {d for d, _ in wanted}
    table = table.filter(pa.array([d in mine for d in table["doc_id"].to_pylist()], pa.bool_()))
    found = {}
    for d, s in zip(table["doc_id"].to_pylist(), spans.shingle_sets(table["text"], n), strict=True):
        if (k := (d, set_key(s))) in wanted:
            found[k] = s
    return [(k[0], s) for k, s in sorted(found.items())]


def signatures(size: int, tokens: np.ndarray, df: np.ndarray, percent: int, rare: int = RARE) -> tuple[np.ndarray, int]:
    """(index entries, shingles of this document alone) of one set, by step 3."""
    u = int((df == 1).sum())
    need = size - -(-percent * size // 100) + 1 - u
    if need <= 0 or size < 2:
        return np.zeros(0, _U), u  # it has no partner but its equals
    shared = df > 1
    tokens, df = tokens[shared], df[shared]
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    base = 100 / percent * (1 + 1e-9)
    level = int(math.log(size) / math.log(base))
    out = []
    for s in (level, level + 1):
        g = max(1, int((1 - percent / 100) * base ** (s - 1) / SUBCLASS))
        often = df > rare
        kind = (spans.mix(tokens) % _U(g)).astype(np.int64)
        cost = np.ones(len(tokens), np.int64)
        where = np.flatnonzero(often)
        if len(where):
            cost[where[np.unique(kind[where], return_index=True)[1]]] = 0
        stop = int(np.searchsorted(np.cumsum(cost), need)) + 1
        t, k, o = tokens[:stop], kind[:stop], often[:stop]
        tag = _U((s + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        out.append(spans.mix(t[~o] ^ tag))
        t, k = t[o], k[o]
        order = np.lexsort((t, k))
        t, k = t[order], k[order]
        step = 1
        while step < len(t) and (same := k[step:] == k[:-step]).any():
            out.append(spans.mix(spans.mix(t[:-step][same]) + t[step:][same] ^ tag))
            step += 1
    return np.unique(np.concatenate(out)), u


def _entries(n: int, percent: int, bits: int):
    def run(docs: pa.Table, other: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], []]
        if docs.num_rows and other.num_rows:
            reps = _representatives(docs, other.filter(pa.compute.is_valid(other["key"])), n)
            answers = other.filter(pa.compute.is_valid(other["seen"]))
            if reps:
                every = np.concatenate([s for _, s in reps])
                keys, _, where = counts.cut(every, np.ones(len(every)), bits)
                df = counts.totals(answers, keys, bits)[where]
                at = 0
                for d, s in reps:
                    sig, u = signatures(len(s), s, df[at : at + len(s)], percent)
                    at += len(s)
                    cols[0].append(sig.view(np.int64))
                    for c, v in zip(cols[1:], (d, u), strict=True):
                        c.append(np.full(len(sig), v, np.int64))
        whole = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("sig", "rep", "u"), whole, strict=True)})

    return run


def _linked(both, size, percent: int):
    """Do sets link that have ``both`` members in common and ``size`` in all, counted twice where common?"""
    return 100 * both >= percent * (size - both)


_DIFFS = "a long, h long, n_a long, n_h long, linked boolean, lacks binary, beyond binary"


def _verify(n: int, percent: int):
    """Rows (a, h, text_a, text_h) to (a, h), their sizes, whether they link, and their differences."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, VERIFIED):
                batch = whole.slice(at, VERIFIED)
                one, hub = (list(spans.shingle_sets(batch.column(k), n)) for k in ("text_a", "text_h"))
                lacks = [np.flatnonzero(~np.isin(h, a, assume_unique=True)).astype("<u4") for a, h in zip(one, hub, strict=True)]
                beyond = [np.setdiff1d(a, h, assume_unique=True) for a, h in zip(one, hub, strict=True)]
                n_a, n_h = (np.array([len(x) for x in sets], np.int64) for sets in (one, hub))
                linked = _linked(n_h - np.array([len(x) for x in lacks], np.int64), n_a + n_h, percent)
                arrays = [batch.column("a"), batch.column("h"), pa.array(n_a), pa.array(n_h), pa.array(linked), pa.array([x.tobytes() for x in lacks], pa.binary()), pa.array([x.tobytes() for x in beyond], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "h", "n_a", "n_h", "linked", "lacks", "beyond"])

    return run


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, by products of bit rows."""
    out = np.zeros((len(x), len(y)), np.float32)
    own, others = (np.concatenate(s) if s else np.zeros(0, _U) for s in (x, y))
    shared = np.intersect1d(own, others)
    rows = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y)]
    marks = [np.searchsorted(shared, v) for v in (own, others)]
    real = [(m < len(shared)) & (shared[np.minimum(m, max(0, len(shared) - 1))] == v) if len(shared) else np.zeros(len(v), bool) for m, v in zip(marks, (own, others), strict=True)]
    for at in range(0, len(shared), 2048):
        tiles = []
        for s, r, m, ok in zip((x, y), rows, marks, real, strict=True):
            on = ok & (m >= at) & (m < at + 2048)
            tile = np.zeros((len(s), min(2048, len(shared) - at)), np.float32)
            tile[r[on], m[on] - at] = 1
            tiles.append(tile)
        out += tiles[0] @ tiles[1].T
    return out


def _cell_links(left: list[dict], right: list[dict], percent: int) -> set[tuple[int, int]]:
    """Links between two blocks of members of a hub, one a left member and component."""
    found: set[tuple[int, int]] = set()
    for at in range(0, len(left), 512):
        x = left[at : at + 512]
        for start in range(0, len(right), 512):
            y = right[start : start + 512]
            sets = [[np.frombuffer(r[k], kind) for r in side] for k, kind in (("lacks", "<u4"), ("beyond", "<u8")) for side in (x, y)]
            size = [np.array([r["n_a"] for r in side], np.int64) for side in (x, y)]
            lost, more = ([np.array([len(v) for v in s], np.int64) for s in pair] for pair in (sets[:2], sets[2:]))
            total = size[0][:, None] + size[1][None]
            may = np.array([r["component"] for r in x])[:, None] != np.array([r["component"] for r in y])[None]
            # No more can be in common than the hub has left of both and both have beyond it.
            may &= _linked(x[0]["n_h"] - np.maximum(lost[0][:, None], lost[1][None]) + np.minimum(more[0][:, None], more[1][None]), total, percent)
            may &= _linked(np.minimum(size[0][:, None], size[1][None]), total, percent)
            rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
            if not len(rows):
                continue
            part = np.ix_(rows, cols)
            common = [_common([s[0][i] for i in rows], [s[1][i] for i in cols]).astype(np.int64) for s in (sets[:2], sets[2:])]
            both = x[0]["n_h"] - lost[0][rows, None] - lost[1][None, cols] + common[0] + common[1]
            for i, js in zip(rows, may[part] & _linked(both, total[part], percent), strict=True):
                first = {y[cols[j]]["component"]: y[cols[j]]["a"] for j in np.flatnonzero(js)[::-1]}
                found |= {(x[i]["a"], b) for b in first.values()}
    return found


def _across(percent: int):
    """Links between members of a hub that are in different components, from cells (h, i, j) in order: one cell is held at a time."""

    def run(batches):
        cell, sides = None, ([], [])

        def links():
            found = sorted(_cell_links(*sides, percent))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if (own := (row["h"], row["i"], row["j"])) != cell:
                        if all(sides):
                            yield links()
                        cell, sides = own, ([], [])
                    sides[row["right"]].append(row)
        if all(sides):
            yield links()

    return run


def _differences(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The (saved) pairs (a, h) with what :func:`_verify` finds, from the texts of both."""
    text = docs.select("doc_id", "text")
    one = text.join(hinted(pairs), F.col("doc_id") == F.col("a")).select("a", "h", F.col("text").alias("text_a"))
    hubs = saved(pairs.select(F.col("h").alias("hub")).distinct())
    other = text.join(hinted(hubs), F.col("doc_id") == F.col("hub")).select(F.col("hub").alias("h"), F.col("text").alias("text_h"))
    return one.join(other, "h").select("a", "h", "text_a", "text_h").mapInArrow(_verify(n, percent), _DIFFS)


def _beyond(batches):
    """Rows (h, a, t) of the shingles that members have beyond their hub."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            sets = [np.frombuffer(x, "<i8") for x in batch.column("beyond").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([batch.column("h").take(row), batch.column("a").take(row), pa.array(np.concatenate(sets), pa.int64())], names=["h", "a", "t"])


def _may_link(members: DataFrame, percent: int) -> DataFrame:
    """Members (h, a, n_a, n_h, lacks, beyond, least, blocks, ..) without those of large hubs that link with no other member.

    A member of n_a shingles needs ceil(percent * (n_a + n) / (100 + percent)) in common with
    one of n.  It has n_h - |lacks| with the hub, so that the rest must be beyond it; a member
    that has fewer shingles there that any other member has, too, is left out.
    """
    large = members.where("blocks > 1")
    tokens = large.select("h", "a", "beyond").mapInArrow(_beyond, "h long, a long, t long")
    often = tokens.groupBy("h", "t").agg(F.count("*").alias("c")).where("c > 1").select("h", "t")
    shared = tokens.join(often, ["h", "t"], "left_semi").groupBy("h", "a").agg(F.count("*").alias("shared"))
    up = lambda x, by: F.expr(f"({x} + {by - 1}) div {by}")
    fewest = members.withColumn("other", F.greatest("least", up(f"{percent} * n_a", 100)))
    need = up(f"{percent} * (n_a + other)", 100 + percent) - (F.col("n_h") - F.octet_length("lacks") / 4)
    both = fewest.withColumn("need", need).join(shared, ["h", "a"], "left")
    return both.where((F.col("blocks") <= 1) | (F.col("need") <= 0) | (F.coalesce("shared", F.lit(0)) >= F.col("need"))).select(members.columns)


def _links_across(diffs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links between components among the members of each hub."""
    itself = diffs.groupBy("h").agg(F.max("n_h").alias("n_h")).select(F.col("h").alias("a"), "h", F.col("n_h").alias("n_a"), "n_h", F.lit(True).alias("linked"), F.lit(b"").alias("lacks"), F.lit(b"").alias("beyond"))
    members = diffs.union(itself).join(groups.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    sizes = members.groupBy("h", "component").agg(F.count("*").alias("count"), F.min("n_a").alias("least"))
    hubs = sizes.groupBy("h").agg(F.sum("count").alias("size"), F.count("*").alias("parts"), F.max_by("component", F.struct("count", "component")).alias("main"), F.min("least").alias("least"))
    hubs = hubs.where("parts > 1").withColumn("blocks", F.ceil(F.col("size") / F.greatest(F.lit(BLOCK), 2.5 * F.sqrt("size"))))
    open_ = saved(members.join(hubs.select("h", "main", "least", "blocks"), "h").select("h", "a", "n_a", "n_h", "component", "lacks", "beyond", "main", "least", "blocks"))
    open_ = _may_link(open_, percent).withColumn("block", F.pmod(F.xxhash64("a"), "blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = open_.where("component <> main").withColumn("j", every).withColumn("i", F.col("block")).withColumn("right", F.lit(0))
    right = open_.withColumn("i", every).withColumn("j", F.col("block")).withColumn("right", F.lit(1))
    cells = left.unionByName(right).select("h", "i", "j", "right", "a", "n_a", "n_h", "component", "lacks", "beyond")
    return cells.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(_across(percent), "a long, b long")


def shingle_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (``id_col``, n_shingles, class_id, component_id).

    n_shingles: size of the row's set.  class_id: smallest id among documents of equal
    sets.  component_id: smallest id that links reach.  Cases: a null or blank text has no
    shingle, links with nothing and is its own class; fewer than n words are one shingle; a
    very long text is a pass of its own, in memory that grows with it; a similarity of exactly
    the threshold links; rows of one id are one node, whatever their texts; a null id links with
    nothing and has null class and component; an empty table gives no row; further columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = saved(text.mapInArrow(_keys(n), "doc_id long, n_shingles long, key binary"))
    used = rows.where("doc_id is not null and n_shingles > 0")
    classes = saved(used.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.countDistinct("doc_id").alias("copies")))
    size = text.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    total = classes.agg(F.sum("n").alias("s")).first()["s"] or 0
    batches, bits = counts.plan(spark, size, total)
    text_b = text.where("doc_id is not null and text is not null").withColumn("b", counts.batch_of("doc_id", batches))
    # A set of one shingle links with its equals alone.
    reps = classes.where("n > 1").select(counts.batch_of("rep", batches).alias("b"), F.col("rep").alias("doc_id"), "key")

    def keys_of(docs: pa.Table, ids: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = [s for _, s in _representatives(docs, ids, n)]
        every = np.concatenate(sets) if sets else np.zeros(0, _U)
        return every, np.ones(len(every), np.int64)

    def send(docs: pa.Table, ids: pa.Table) -> pa.Table:
        keys, c, _ = counts.cut(*keys_of(docs, ids), bits)
        return counts._send(ids["b"][0].as_py() if ids.num_rows else -1, keys, c, bits)

    sent = text_b.groupBy("b").cogroup(reps.groupBy("b")).applyInArrow(send, "r int, b long, k binary, n binary")
    answers = sent.groupBy("r").applyInArrow(counts._add, counts.COUNTS)
    other = reps.unionByName(answers, allowMissingColumns=True)
    entries = saved(text_b.groupBy("b").cogroup(other.groupBy("b")).applyInArrow(_entries(n, percent, bits), "sig long, rep long, u long"))

    hubs = entries.groupBy("sig").agg(F.min(F.struct("u", F.col("rep").alias("h"))).alias("hub"), F.count("*").alias("c")).where("c > 1")
    near = entries.select("sig", F.col("rep").alias("a")).join(hubs.select("sig", F.col("hub.h").alias("h")), "sig")
    pairs = saved(near.where("a <> h").select("a", "h").distinct())
    diffs = saved(_differences(text, pairs, n, percent))
    links = diffs.where("linked").select("a", F.col("h").alias("b"))
    across = _links_across(diffs, components(links), percent)
    # Rows of one id with different texts are one node.
    same = rows.where("doc_id is not null and n_shingles > 0").join(classes.select("key", "rep"), "key").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    groups = components(links.union(across).union(same))
    reach = classes.join(groups, F.col("rep") == F.col("node"), "left").where("copies > 1 or component is not null").select("key", F.col("rep").alias("class"), F.coalesce("component", "rep").alias("component"))
    return (
        rows.join(reach, "key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.coalesce("class", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
            F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")))
        .withColumnRenamed("doc_id", id_col)
    )
