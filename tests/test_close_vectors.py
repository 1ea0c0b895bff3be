"""Vectors whose scores are equal to six digits but not to nine: the queries rank them as their SQL does."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lorewell.operators import search
from lorewell.plans import catalog

from .oracle import compare


@pytest.mark.parametrize("name", ["graph_top10", "vector_prefiltered", "vector_top10", "vector_postfiltered"])
def test_equal_scores_of_six_digits_go_to_the_smaller_id(spark, tmp_path, name):
    """Two hundred near copies, the nearer the larger their id, so that nine digits would choose others."""
    step = np.arange(200) * 2.0**-23
    rows = [(i, [1.0, 1.0 + float(s)], i % 2) for i, s in enumerate(step)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "e"))
    next((tmp_path / "e").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    compare(spark, str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name])


def test_halves_are_rounded_as_in_sql():
    rng = np.random.default_rng(3)
    x = np.r_[rng.integers(-(10**6), 10**6, 50_000) * 1000 + 500, rng.integers(-(10**9), 10**9, 50_000)] / 1e9
    rows = pa.table({"i": np.arange(len(x)), "x": x})
    want = [r[1] for r in duckdb.sql("SELECT i, round(round(x, 9), 6) FROM rows ORDER BY i").fetchall()]
    assert search.rounded(x, 6).tolist() == want
