"""Every query with SQL gives the rows of its SQL; every query has rows."""

import pytest

from lorewell.plans import catalog

from .oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, SMALL, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["vector_top10", "vector_prefiltered", "vector_postfiltered"])
def test_vector_queries_are_every_fiftieth_id(spark, name):
    ids = [r.vec_id for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 50 = 0").collect()]
    assert {r.query_id for r in catalog.queries()[name](spark, SMALL).select("query_id").distinct().collect()} == set(ids)


def test_whole_tables_reach_the_operators(spark):
    q = catalog.queries()
    table = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    distinct = lambda frame, c: {r[0] for r in frame.select(c).distinct().collect()}
    assert distinct(q["stripped_pages"](spark, SMALL), "page") == distinct(table("orders"), "o_orderkey")
    assert distinct(q["combined_licences"](spark, SMALL), "source") == distinct(table("documents"), "source")
    assert distinct(q["feature_overlap"](spark, SMALL), "query_id") == distinct(table("events").where("user_id % 50 = 0"), "user_id")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_has_rows(spark, name):
    """No comparison passes for want of rows; dupes apart, which a table may lack."""
    assert catalog.queries()[name](spark, SMALL).limit(1).count() == 1
