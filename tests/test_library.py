"""Operators of the library against plain Python, and round trips over files."""

import json
import random

from lorewell.operators import context, library, provenance, search
from lorewell.plans import catalog


def grown(sizes, best, budget):
    """The window of a document by its definition: all if it fits, else forward, then back, until full."""
    if sum(sizes) <= budget:
        return set(range(len(sizes)))
    lo = hi = best
    total = sizes[best]
    while total < budget and (lo > 0 or hi < len(sizes) - 1):
        if hi < len(sizes) - 1:
            hi += 1
            total += sizes[hi]
        if total < budget and lo > 0:
            lo -= 1
            total += sizes[lo]
    return set(range(lo, hi + 1))


def test_source_window(spark):
    rng = random.Random(1)
    rows, best, want = [], [], set()
    for doc in range(60):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 12))]
        at = rng.randrange(len(sizes))
        rows += [(doc, i, "x" * n) for i, n in enumerate(sizes)]
        best.append((doc, at))
        want |= {(doc, i) for i in grown(sizes, at, 100)}
    got = library.source_window(spark.createDataFrame(rows, "doc_id long, seq long, text string"), spark.createDataFrame(best, "doc_id long, seq long"), 100)
    assert {(r.doc_id, r.seq) for r in got.collect()} == want


def test_stoplist_leaves_a_query_of_stopwords_whole(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "a bird")], "id long, text string")
    asked = spark.createDataFrame([(1, "the"), (2, "the cat")], "query_id long, query string")
    stop = spark.createDataFrame([("the",)], "term string")
    got = {(r.query_id, r.id) for r in search.bm25(search.postings(docs, {"text": 1.0}, "id"), asked, stop=stop).collect()}
    assert got == {(1, 1), (1, 2), (2, 1)}


def test_content_version(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k long, v string")
    version = lambda f: context.content_version(f, ["k", "v"]).first()
    assert version(a) == version(a.orderBy("v").repartition(3)) and version(a).rows == 3
    assert version(a).version != version(a.distinct()).version
    assert version(a.limit(0)).rows == 0


def test_bundles_and_files(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string")
    library.export_bundle({"nodes": nodes, "edges": nodes.limit(0)}, str(tmp_path / "b"), "mine", "m1")
    lines = [json.loads(x) for p in (tmp_path / "b" / "manifest").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((x["table"], x["rows"], x["model"]) for x in lines) == [("edges", 0, "m1"), ("nodes", 2, "m1")]
    assert spark.read.parquet(str(tmp_path / "b" / "nodes")).count() == 2
    (tmp_path / "lib" / "deep").mkdir(parents=True)
    (tmp_path / "lib" / "deep" / "A.MD").write_text("# A")
    (tmp_path / "lib" / "x.bin").write_text("x")
    files = library.read_library(spark, str(tmp_path / "lib")).collect()
    assert [(f.extractor, f.path.rsplit("/", 1)[1]) for f in files] == [("text", "A.MD")]


def test_questions_and_empty_inputs(spark):
    q = spark.createDataFrame([("Gradually, on BOTH sides; immediate numbness",), ("",), (None,)], "q string")
    got = [r.f for r in q.select(context.context_features(q.q).alias("f")).collect()]
    assert got == [["laterality:bilateral", "onset:gradual", "quality:numb", "timing:immediate"], [], []]
    vectors = library.hash_vectors(q.selectExpr("1L id", "q"), "id", "q").collect()
    assert abs(sum(x * x for x in vectors[0].vec) - 1) < 1e-9 and vectors[1].vec is None and vectors[2].vec is None
    assert library.sample(q.selectExpr("monotonically_increasing_id() id", "q"), 2).count() == 2


def _bundle(spark):
    """Sources, edges, support of edges and of nodes; some name nothing, some sources are not registered."""
    docs = spark.createDataFrame([(i, "abc"[i % 3], f"t{i % 4}", "active") for i in range(40)] + [(None, "a", "t0", "active")], "doc_id long, bundle string, title string, status string")
    edges = spark.createDataFrame([(i, i % 7 if i % 5 else None, i % 11) for i in range(60)] + [(None, 1, 90), (3, 91, 92)], "edge_id long, src long, dst long")
    edge_support = spark.createDataFrame([(i * 7 % 60 if i % 6 else None, i % 50) for i in range(80)], "edge_id long, doc_id long").distinct()
    node_support = spark.createDataFrame([(i % 9 + 5 if i % 8 else None, i % 50) for i in range(50)], "node long, doc_id long").distinct()
    return docs, edges, edge_support, node_support


def test_assembled_tables_equal_plain_python(spark):
    """A node without an id is one row, as others are; support that names no edge stays."""
    tables = _bundle(spark)
    docs, edges, edge_support, node_support = ([tuple(r) for r in t.collect()] for t in tables)
    chosen = {d for d, b, t, _ in docs if b in "ab" and t != "t1"}
    support = {(e, d) for e, d in edge_support if d is not None and d in chosen}
    own = {e for e in edges if e[0] is not None and e[0] in {x for x, _ in support}}
    mine = {n for n, d in node_support if d is not None and d in chosen}
    nodes = {(n, False) for n in mine} | {(n, True) for _, *ends in own for n in ends if n not in mine}
    out = provenance.assemble(*tables, include=["a", "b"], exclude=["t1"])
    rows = lambda frame, *c: sorted((tuple(r) for r in frame.select(*c).collect()), key=repr)
    assert rows(out["edge_support"], "edge_id", "doc_id") == sorted(support, key=repr) and any(e is None for e, _ in support)
    assert rows(out["edges"], "edge_id", "src", "dst") == sorted(own, key=repr)
    assert rows(out["nodes"], "node", "borrowed") == sorted(nodes, key=repr) and any(n is None for n, _ in nodes)
    assert rows(provenance.closure(*tables[1:], tables[0].where("bundle in ('a', 'b') and title <> 't1'")), "node", "borrowed") == sorted(nodes, key=repr)


def test_support_is_shuffled_once_for_all_assembled_tables(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        out = catalog.queries()["assembled_tables"](spark, "/root/testdata/sf0.001")
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set(key, before)
    made = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    # Edges, support with and without an edge, support of nodes, sources; then the edges' ids and the nodes.
    assert len(made) <= 7, made
