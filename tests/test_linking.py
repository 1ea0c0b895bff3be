"""Linking in rounds equals a plain loop over the concepts; blocks equal brute force; a stopped pass goes on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import blocks, graph, linking
from lorewell.plans import catalog

NODES = "ord long, id string, label string, aliases array<string>, vec array<double>"
BATCH = "ord long, label string, kind string, aliases array<string>, vec array<double>"


def plain_link(nodes, batch, low, high, node_id, stems):
    """One concept after the other, as lists."""
    there = [{"ord": o, "id": i, "own": stems(la), "terms": set(stems(la)).union(*map(stems, al or [])), "vec": v} for o, i, la, al, v in nodes]
    out = {}
    for o, label, kind, aliases, vec in sorted(batch):
        own, terms = set(stems(label)), set(stems(label)).union(*map(stems, aliases or []))
        scored = [(round(float(np.dot(n["vec"], vec)), 9), -n["ord"], n) for n in there if n["vec"] is not None] if vec is not None else []
        sim, _, best = max(scored, key=lambda x: x[:2]) if scored else (None, None, None)
        if best is None or sim < low:
            sim, best = None, None
        key, specific = node_id(label, kind), None
        if best is not None and sim >= high and terms & best["terms"]:
            best["terms"] |= terms
            out[o] = (best["id"], "same", best["id"], None)
            continue
        action = "new"
        if best is not None:
            other = set(best["own"])
            specific = "concept" if other and other < own else "best" if own and own < other else None
            action = "distinct_isa" if specific else "distinct_adjudicate"
        if all(n["id"] != key for n in there):
            there.append({"ord": o, "id": key, "own": own, "terms": set(terms), "vec": vec})
        out[o] = (key, action, best and best["id"], specific)
    return out


def both(spark, nodes, batch, low, high):
    labels = sorted({x for _, _, la, al, _ in nodes for x in [la, *(al or [])]} | {x for _, la, _, al, _ in batch for x in [la, *(al or [])]})
    stemmed = {r.label: r.s for r in spark.createDataFrame([(x,) for x in labels], "label string").select("label", graph.stems(F.col("label")).alias("s")).collect()}
    kinds = sorted({(b[1], b[2]) for b in batch})
    ids = {(r.label, r.kind): r.k for r in spark.createDataFrame(kinds, "label string, kind string").select("label", "kind", graph.key_hash(F.lit("node"), F.col("label"), F.col("kind")).alias("k")).collect()}
    want = plain_link(nodes, batch, low, high, lambda a, b: ids[a, b], lambda x: stemmed[x])
    rows = linking.link_batch(spark.createDataFrame(nodes, NODES), spark.createDataFrame(batch, BATCH).repartition(4), low, high).collect()
    assert len(rows) == len(batch)
    return {r.ord: (r.node, r.action, r.best, r.specific) for r in rows}, want


def made(seed, n_nodes=12, n_batch=50):
    rng, words = random.Random(seed), ["dry", "eye", "eyes", "lens", "pain", "acute"]
    centres = [np.array([rng.gauss(0, 1) for _ in range(6)]) for _ in range(5)]

    def vec():
        if rng.random() < 0.05:
            return None
        v = rng.choice(centres) + 0.35 * np.array([rng.gauss(0, 1) for _ in range(6)])
        return [float(x) for x in v / np.linalg.norm(v)]

    label = lambda: " ".join(rng.sample(words, rng.randint(1, 3)))
    aliases = lambda: None if rng.random() < 0.3 else [label() for _ in range(rng.randint(0, 2))]
    nodes = [(i, f"n{i}", label(), aliases(), vec()) for i in range(n_nodes)]
    batch = [(1000 + i, label(), rng.choice("xy"), aliases(), vec()) for i in range(n_batch)]
    for i in range(0, n_batch, 7):  # copies of an earlier concept
        j = rng.randrange(n_batch)
        batch[i] = (1000 + i, *batch[j][1:])
    rng.shuffle(batch)
    return nodes, batch


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_a_plain_loop(spark, seed):
    nodes, batch = made(seed)
    got, want = both(spark, nodes, batch, 0.72, 0.86)
    assert got == want
    assert {a for _, a, _, _ in want.values()} == {"same", "new", "distinct_isa", "distinct_adjudicate"}


def test_copies_join_the_first_and_an_alias_opens_a_node(spark):
    v, w = [1.0, 0.0], [0.95, 0.3122498999]
    batch = [(i, "dry eye", "x", None, v) for i in range(10, 200)] + [(300, "sicca", "x", ["dry"], v), (301, "sicca", "x", None, w), (302, "other", "x", None, None)]
    got, want = both(spark, [], batch, 0.72, 0.86)
    assert got == want and got[10][1] == "new" and got[199][1] == "same" and got[301][:2] == (got[10][0], "same") and got[302][1] == "new"


def test_empty_batch(spark):
    assert linking.link_batch(spark.createDataFrame([], NODES), spark.createDataFrame([], BATCH)).count() == 0


def test_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 8)) * 3
    v = centres[rng.integers(0, 4, 700)] + rng.normal(size=(700, 8)) * 0.3
    v[300:500] = v[3]  # a third as copies
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9999, None)], "id long, vec array<double>")
    asked = rows.where("id % 5 = 0").selectExpr("id", "vec", "3 keep", "0.6D floor", f"{blocks.ANY} tie")
    score = np.round(v @ v.T, 9)
    for earlier in (False, True):
        got = {}
        for r in blocks.near_in_blocks(asked, rows, earlier, size=64).collect():
            got.setdefault(r.query_id, []).append((-r.score, r.id))
        for q in range(0, 700, 5):
            want = sorted((-score[q, j], j) for j in range(700) if score[q, j] >= 0.6 and (j < q if earlier else j != q))[:3]
            assert [j for _, j in sorted(got.get(q, []))[:3]] == [j for _, j in want], (q, earlier)


def test_a_stopped_pass_goes_on(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id id", "embedding vec", "label = 3 prior", "label")
    asked, log, seen = v.where("label = 0"), str(tmp_path / "log"), []
    whole = {(r.a, r.b) for r in linking.linker_candidates(v, asked, None, 8, 0.2).collect()}

    def judge(stop):
        def run(rows):
            if len(seen) == stop:
                raise RuntimeError("stopped")
            seen.append(sorted((r.a, r.b) for r in rows.collect()))
            return rows.selectExpr("b a", "a b", "case when (a + b) % 10 <> 0 then 'related' end relation", "0.5 confidence")

        return run

    with pytest.raises(RuntimeError):
        linking.link_pass(v, asked, log, judge(2), 8, 0.2, steps=5)
    first = {p for s in seen for p in s if sum(p) % 10}
    assert {(r.a, r.b) for r in spark.read.parquet(log).collect()} == first
    seen.clear()
    linking.link_pass(v, asked, log, judge(99), 8, 0.2, steps=5)
    assert {p for s in seen for p in s} == whole - first
    assert {(r.a, r.b) for r in spark.read.parquet(log).collect()} == {p for p in whole if sum(p) % 10}


def test_linked_concepts_are_the_whole_batch(spark):
    d = "/root/testdata/sf0.001"
    rows = catalog.queries()["linked_concepts"](spark, d).collect()
    e = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    label = lambda r: f"k{r.label} v{r.vec_id % 5}"
    nodes = [(r.vec_id, str(r.vec_id), label(r), [f"w{r.vec_id % 7}"], [float(x) for x in r.embedding]) for r in e if r.vec_id % 50]
    batch = [((1 << 40) + r.vec_id, label(r), str(r.vec_id % 2), [f"w{r.vec_id % 7}"], [float(x) for x in r.embedding]) for r in e if r.vec_id % 50 == 0]
    _, want = both(spark, nodes, batch, 0.25, 0.35)
    assert {(1 << 40) + r.vec_id: (r.node, r.action, r.best, r.specific) for r in rows} == want
