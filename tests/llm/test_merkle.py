import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lorewell.llm import merkle, queries

from . import fixtures

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return H(*map(field, row))


def tree(nodes):
    """The root, and each node's siblings as (left, right), level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
            proofs[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        nodes, at = [H(*nodes[j : j + 8]) for j in range(0, len(nodes), 8)], [k // 8 for k in at]
    return nodes[0], proofs


def brute(rows):
    """Rows as (doc_id, text, lang, source, n_chars)."""
    lower = lambda d, t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) if t is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else t
    made = sorted(((x[2] is not None, (x[2] or "").encode(), x[0] is not None, x[0] or 0, leaf((x[0], x[3], x[2], x[4], x[1])), leaf((x[0], x[3], x[2], x[4], lower(x[0], x[1]))), x) for x in rows), key=lambda r: r[:6])
    groups = {}
    for r in made:
        groups.setdefault(r[:2], []).append(r)
    trees = {g: tree([r[4] for r in rs]) for g, rs in groups.items()}
    root, tops = tree([t[0] for t in trees.values()]) if trees else (None, [])
    out = []
    for (g, rs), upper in zip(groups.items(), tops):
        for r, own in zip(rs, trees[g][1]):
            node, path = r[5], own + upper
            for a, b in path:
                node = H(a, node, b)
            out.append((r[6][0], r[4], trees[g][0], root, H(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=str)


def got(docs):
    lowered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))
    return sorted((tuple(r) for r in merkle.manifest(docs, FIELDS, tampered={"text": lowered}).collect()), key=str)


@pytest.mark.parametrize("levels", [4, 1])
def test_equals_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = fixtures.rows() + [(1000 + i, f"Text {i}", "en", None, i) for i in range(600 if levels == 1 else 90)]
    docs = spark.createDataFrame(rows, fixtures.DOCS).repartition(5)
    more = docs.select("*", *[F.lit("v").alias(c) for c in ("g", "key", "node", "pos", "n", "block", "_m", "leaf")])
    out = got(more)
    assert out == brute(rows)
    assert {x[6] for x in out} == {True, False}


def test_sizes_around_full_runs(spark):
    for n in (1, 7, 8, 9, 64, 65):
        rows = [(i, "A", "en" if i else None, "s", 1) for i in range(n)]
        assert got(spark.createDataFrame(rows, fixtures.DOCS)) == brute(rows)


def test_many_groups(spark):
    rows = [(i, "a", f"l{i % 70}", "s", 1) for i in range(300)]
    assert got(spark.createDataFrame(rows, fixtures.DOCS)) == brute(rows)


def test_empty_table_and_long_text(spark):
    assert got(fixtures.empty(spark)) == []
    rows = [(3, "Xé" * 2_000_000, "en", "s", 1), (4, None, None, None, None), (None, None, None, None, None)] * 2
    assert got(spark.createDataFrame(rows, fixtures.DOCS)) == brute(rows)


def test_traversal_holds_two_runs_a_level():
    rng = random.Random(1)
    for n in (1, 8, 9, 100, 513, 4096):
        leaves = [H(str(rng.random())) for _ in range(n)]
        root, want = tree(list(leaves))
        assert list(merkle.paths(leaves, merkle.height(n))) == want and merkle.top(leaves, merkle.height(n)) == root
    walk = merkle.paths(leaves, 4)
    for i, _ in enumerate(walk):
        if i % 97 == 0:
            desired = walk.gi_frame.f_locals["desired"]
            assert sum(len(t) for d in desired for t in d.tails) + sum(len(d.run) for d in desired) <= 4 * 8 + 4 * 4 * 8


def test_tampering_of_text_is_found(spark):
    rows = {r.doc_id: r for r in queries.op13_merkle_manifest(spark, fixtures.SMALL).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{fixtures.SMALL}/documents.parquet").collect()}
    for d, r in rows.items():
        hit = zlib.crc32(str(d).encode()) % 3 == 0 and docs[d] is not None and any("A" <= c <= "Z" for c in docs[d])
        assert r.verified is not hit
