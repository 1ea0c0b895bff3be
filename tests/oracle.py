"""Runs a query's SQL in DuckDB over the same tables and compares all rows."""

import math
from pathlib import Path

import duckdb


def normal(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return [normal(v) for v in x]
    if isinstance(x, dict):
        return {k: normal(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return normal(x.asDict())
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if type(x).__name__ == "Decimal":
        return normal(float(x)) if x % 1 else int(x)
    return x


def duck(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def compare(spark, sf_dir, query, sql):
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    result = duck(sf_dir).sql(sql)
    assert sorted(result.columns) == names
    got = sorted((repr(normal([r[n] for n in names])) for r in frame.collect()))
    at = [result.columns.index(n) for n in names]
    want = sorted((repr(normal([r[i] for i in at])) for r in result.fetchall()))
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, (len(bad), bad[:2])
