"""Queries of linking and of digests that merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.operators import digests, linking, search
from lorewell.plans.registry import Registry, table

R = Registry()


@R.query()
def linked_concepts(spark, d):
    """Vectors whose id 50 divides as a batch of new concepts against all others as nodes; tests hold it against a plain loop."""
    v = table(spark, d, "embeddings")
    label = F.concat(F.lit("k"), F.col("label").cast("string"), F.lit(" v"), (F.col("vec_id") % 5).cast("string"))
    rows = v.select(F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("id"), label.alias("label"), (F.col("vec_id") % 2).cast("string").alias("kind"), F.array(F.concat(F.lit("w"), (F.col("vec_id") % 7).cast("string"))).alias("aliases"), F.col("embedding").alias("vec"))
    batch = rows.where("ord % 50 = 0").withColumn("ord", F.col("ord") + (1 << 40))
    out = linking.link_batch(rows.where("ord % 50 <> 0").drop("kind"), batch.drop("id"), 0.25, 0.35)
    return out.select((F.col("ord") - (1 << 40)).alias("vec_id"), "node", "action", "best", F.round("similarity", 6).alias("similarity"), "specific")


@R.query("""WITH s AS (SELECT b.vec_id AS x, a.vec_id AS y,
  round(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 9) AS similarity
  FROM embeddings a, embeddings b WHERE b.label = 0 AND a.vec_id <> b.vec_id AND a.label <> 3),
t AS (SELECT least(x, y) AS a, greatest(x, y) AS b, similarity FROM s WHERE similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY x ORDER BY similarity DESC, y) <= 8)
SELECT a, b, round(max(similarity), 6) AS similarity FROM t WHERE b - a <> 1 GROUP BY a, b""")
def linker_candidates(spark, d):
    """Anchors of one label and their eight nearest nodes, of which one label's are prior ones; neighbours by id were judged before."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") == 3).alias("prior"), "label")
    judged = v.select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    return linking.linker_candidates(v, v.where("label = 0"), judged, 8, 0.2).withColumn("similarity", F.round("similarity", 6))


@R.query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 9 = 0 THEN 0.0 ELSE x::DOUBLE * (vec_id % 5 + 1) END) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM v)
SELECT vec_id, CASE WHEN size > 0 THEN round(v[1] / size, 6) END AS first, CASE WHEN size > 0 THEN round(list_sum(list_transform(v, lambda x: x / size * x / size)), 6) END AS length FROM n""")
def unit_vectors(spark, d):
    """Scaled vectors brought back to length one; the zero vector has none."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(F.col("vec_id") % 9 == 0, 0.0).otherwise(x.cast("double") * (F.col("vec_id") % 5 + 1))).alias("v"))
    return v.select("vec_id", search.unit(F.col("v")).alias("u")).select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(search.dot(F.col("u"), F.col("u")), 6).alias("length"))


# Tables, the label of a row, and what its digest reads.
_TABLES = {
    "region": ("r_name", ["r_regionkey", "r_name"]),
    "nation": ("n_name", ["n_nationkey", "n_name", "n_regionkey"]),
    "customer": ("c_mktsegment", ["c_custkey", "c_mktsegment"]),
    "supplier": ("s_name", ["s_suppkey", "s_name", "s_nationkey"]),
    "part": ("p_brand", ["p_partkey", "p_name", "p_brand", "p_size"]),
    "orders": ("o_orderpriority", ["o_orderkey", "o_orderstatus", "o_orderpriority"]),
    "lineitem": ("l_returnflag", ["l_orderkey", "l_linenumber", "l_returnflag", "l_partkey"]),
}
_WORDS_SQL = ", ".join(f"sum(('0x' || substr(h, {1 + 16 * i}, 16))::UBIGINT)::VARCHAR" for i in range(4))


def _hashed(name: str, source: str = "") -> str:
    label, columns = _TABLES[name]
    row = ", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)
    return f"SELECT '{name}' AS tbl, coalesce({label}, '') AS label, sha256(concat({row})) AS h FROM {source or name}"


def _leaves(spark, d, names, frames: dict[str, DataFrame] | None = None) -> DataFrame:
    frames = frames or {n: table(spark, d, n) for n in names}
    return reduce(DataFrame.union, [digests.leaves(frames[n], n, *_TABLES[n]) for n in names])


@R.query(f"""WITH r AS ({" UNION ALL ".join(_hashed(n) for n in ("part", "supplier", "orders"))}),
p AS (SELECT tbl, h, substr(label, 1, i::INT) AS prefix FROM (SELECT *, unnest(range(0, least(length(label), 12) + 1)) AS i FROM r))
SELECT tbl, prefix, count(*) AS rows, sha256(concat_ws('|', count(*)::VARCHAR, {_WORDS_SQL})) AS version FROM p GROUP BY tbl, prefix""")
def region_versions(spark, d):
    """The version of every prefix of labels in three tables."""
    return digests.versions(digests.tree(_leaves(spark, d, ("part", "supplier", "orders"))))


_CHANGED = "(SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey % 5 <> 3)"


@R.query(f"""WITH r AS ({" UNION ALL ".join(_hashed(n, _CHANGED if n == "nation" else "") for n in _TABLES)}),
t AS (SELECT tbl, count(*) AS n, tbl || '=' || sha256(concat_ws('|', count(*)::VARCHAR, {_WORDS_SQL})) AS line FROM r GROUP BY tbl)
SELECT sum(n)::BIGINT AS rows, sha256(string_agg(line, chr(10) ORDER BY tbl) || chr(10) || 'rules/1') AS version FROM t""")
def ruleset_versions(spark, d):
    """The version of a set of seven tables, of which one is changed by taking rows away and adding others."""
    before = digests.tree(_leaves(spark, d, _TABLES))
    n = table(spark, d, "nation").where("n_nationkey % 2 = 0 or n_nationkey % 5 = 3")
    added = n.where("n_nationkey % 5 <> 3").withColumn("n_name", F.lower("n_name"))
    delta = digests.change(_leaves(spark, d, ["nation"], {"nation": n}), _leaves(spark, d, ["nation"], {"nation": added}))
    return digests.ruleset_version(before.union(delta), list(_TABLES), "rules/1")
