"""Merges through chains, cycles and stars end at one live node."""

import random

from pyspark.sql import functions as F

from lorewell.operators import cards, closure, graph


def plain_settle(pairs, support):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out, seen, losers = {}, set(), {a for a, b in pairs if a != b}
    for start in near:
        if start in seen:
            continue
        group, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        seen |= group
        best = min(group, key=lambda x: (x in losers, -support.get(x, 0), x))
        out |= {x: best for x in group if x != best}
    return out


def run(spark, pairs, support):
    merged = spark.createDataFrame(pairs, "loser long, survivor long").repartition(4)
    return {r.loser: r.survivor for r in closure.settle(merged, spark.createDataFrame(list(support.items()) or [(-1, 0)], "id long, n_support long")).collect()}


def test_chains_cycles_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 111)]
    cycle = [(200 + i, 200 + (i + 1) % 10) for i in range(10)]
    star = [(300 + i, 300) for i in range(1, 400)]
    got = run(spark, [*chain, *cycle, *star, *star, (1000, 1000), (None, 5), (6, None)], {204: 9, 207: 9, 300: 1, 350: 99})
    assert got == {**{i: 111 for i in range(100, 111)}, **{i: 204 for i in range(200, 210) if i != 204}, **{i: 300 for i in range(301, 700)}}


def test_random_merges_equal_plain_python(spark):
    rng = random.Random(4)
    for n in (30, 200):
        pairs = [(rng.randrange(n * 2), rng.randrange(n * 2)) for _ in range(n)]
        support = {i: rng.randrange(4) for i in range(n)}
        assert run(spark, pairs, support) == plain_settle(pairs, support)
    assert run(spark, [], {}) == {}


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = closure._checksum
    monkeypatch.setattr(closure, "_checksum", lambda e: rounds.append(1) or real(e))
    out = closure.components(spark.range(600).selectExpr("id a", "id + 1 b"))
    assert {(r.component) for r in out.collect()} == {0} and out.count() == 601 and len(rounds) <= 12


def test_tables_follow_a_chain_to_its_end(spark):
    merged = spark.createDataFrame([(i, i + 1) for i in range(10)], "loser long, survivor long")
    edges = spark.createDataFrame([(0, 50, "a"), (9, 50, "b"), (3, 10, "c"), (10, 0, "d")], "src long, dst long, doc_id string").selectExpr("*", "'f' family", "'t' type", "'+' polarity", "'r' regime", "0.5d trust_weight")
    assert [(r.src, r.dst, r.n_support) for r in graph.merge_nodes(edges, merged).collect()] == [(10, 50, 2)]
    nodes = spark.range(11).selectExpr("id", "concat('n', id) label", "'active' status")
    marked, support, names = cards.merge_node_rows(nodes, spark.range(11).selectExpr("id", "id % 3 doc_id"), spark.createDataFrame([], "id long, alias string"), merged)
    assert {r.id for r in marked.where("status = 'active'").collect()} == {10}
    assert sorted(map(tuple, support.collect())) == [(10, 0), (10, 1), (10, 2)] and names.where("id = 10").count() == 10 == names.count()


def test_a_queue_merges_into_the_node_of_most_support(spark):
    decided = spark.createDataFrame([(1, 2, "same"), (2, 3, "same"), (4, 3, "same"), (4, 9, "is_a"), (7, 8, "deferred")], "a long, b long, decision string")
    nodes = spark.createDataFrame([(1, 2, "active"), (2, 9, "active"), (3, 9, "active"), (4, 1, "active")], "id long, n_support long, status string")
    assert {(r.loser, r.survivor) for r in closure.resolved_merges(decided, nodes).collect()} == {(1, 2), (3, 2), (4, 2)}
