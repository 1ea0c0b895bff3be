"""Approximate search against exact search: recall, and how many vectors or codes each query was held against."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import ann, search

DATA = "/root/testdata"


def vectors_of(spark, sf):
    v = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_graph_recall_and_scores_taken(spark, sf):
    v, q = vectors_of(spark, sf)
    graph = ann.build_graph(v)
    assert graph.count() == v.count()
    found, n = ann.graph_search(graph, q), v.count()
    assert ann.recall(found, search.vector_search(v, q, 10)) >= 0.95
    assert found.agg(F.avg("scored")).first()[0] < (0.2 if n >= 2000 else 0.35) * n


def test_graphs_in_parts_merge(spark, monkeypatch):
    monkeypatch.setattr(ann, "GRAPH_ROWS", 700)
    monkeypatch.setattr(ann, "QUERIES", 15)
    v, q = vectors_of(spark, "sf0.1")
    graph = ann.build_graph(v)
    assert graph.select("part").distinct().count() == 3
    found = ann.graph_search(graph, q, width=40)
    assert ann.recall(found, search.vector_search(v, q, 10)) >= 0.9 and found.groupBy("query_id").count().where("count <> 10").count() == 0
    one = {r.query_id: r.scored for r in ann.graph_search(graph, q.where("query_id < 200"), width=40).collect()}
    assert one == {r.query_id: r.scored for r in found.where("query_id < 200").collect()}


def test_links_go_both_ways_and_are_few():
    x = np.random.default_rng(1).normal(size=(300, 8)).astype(np.float32)
    links = ann._links(x)
    assert len(links) == 300 and max(map(len, links)) <= ann.LINKS and min(map(len, links)) >= ann.NEAR
    s = x @ x.T
    for i in range(0, 300, 37):
        s[i, i] = -np.inf
        assert set(np.argsort(-s[i])[:8]) <= set(links[i].tolist())
    assert [v.tolist() for v in ann._links(x[:1])] == [[]]


def test_codes_recall(spark):
    v, q = vectors_of(spark, "sf0.1")
    index = ann.build_codes(v)
    assert len(index.model.centre) == round(2000**0.5) and index.codes.count() == 2000
    assert index.codes.agg(F.max(F.length("code"))).first()[0] == 16
    assert ann.recall(ann.code_search(index, v, q), search.vector_search(v, q, 10)) >= 0.9


def clustered(spark, n=6000, hot=True):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(60, 24))
    x = centre[rng.integers(0, 60, n)] + 0.15 * rng.normal(size=(n, 24))
    if hot:
        x[: n // 3] = centre[0] + 0.15 * rng.normal(size=(n // 3, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(n, None)], "id long, vec array<double>").repartition(6)
    return v, v.where("id % 50 = 0 and id >= 2000 and vec is not null").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))


def test_few_codes_are_scored_where_vectors_have_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 50)
    v, q = clustered(spark)
    index = ann.build_codes(v)
    assert index.sizes.agg(F.max("salts")).first()[0] > 1
    assert ann.recall(ann.code_search(index, v, q), search.vector_search(v, q, 10)) >= 0.9
    v, q = clustered(spark, hot=False)
    found = ann.code_search(ann.build_codes(v), v, q)
    assert ann.recall(found, search.vector_search(v, q, 10)) >= 0.9 and found.agg(F.avg("scored")).first()[0] <= 0.1 * 6000
    assert index.codes.where("cell = 0")._jdf.queryExecution().executedPlan().toString().count("PushedFilters: [IsNotNull(cell), EqualTo(cell,0)]") >= 1


def test_empty_tables_ties_and_copies(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(40, None)], "id long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, qvec array<double>")
    for found in (ann.graph_search(ann.build_graph(v), q, 5), ann.ivf_search(v, q, 5)):
        assert [(r.query_id, r.score) for r in found.collect()] == [(1, 1.0)] * 5
    for found in (ann.graph_search(ann.build_graph(v.limit(0)), q, 5), ann.ivf_search(v.limit(0), q, 5), ann.graph_search(ann.build_graph(v), q.limit(0), 5), ann.ivf_search(v, q.limit(0), 5)):
        assert found.count() == 0


def test_graph_query_is_exact_where_beams_miss(spark, tmp_path):
    """Twelve groups of vectors without a link between them, more than the beams have entries."""
    from lorewell.plans import catalog

    from .oracle import compare

    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(12, 16), 40, axis=0) + rng.normal(size=(480, 16)) * 0.05
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "e"))
    next((tmp_path / "e").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    compare(spark, str(tmp_path), catalog.queries()["graph_top10"], catalog.oracle_sql()["graph_top10"])
