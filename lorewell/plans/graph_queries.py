"""Queries of the graph, answers, provenance, rules, telemetry, evaluation, importers and lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.operators import ask, cards, closure, evaluate, graph, lexicon, provenance, rules, telemetry
from lorewell.plans.registry import Registry, table
from lorewell.sources import importers

R = Registry()
# Suppliers and parts are nodes, a supply is a claim, orders are the documents that support it.
_TRUST = "CASE left(o_orderpriority, 1) WHEN '1' THEN 0.9 WHEN '2' THEN 0.7 WHEN '3' THEN 0.5 WHEN '4' THEN 0.3 ELSE 0.2 END"
_CLAIMS = f"c AS (SELECT l_suppkey AS src, l_partkey AS dst, l_orderkey AS doc_id, {_TRUST}::DOUBLE AS trust_weight, o_orderstatus AS regime, o_custkey % 50 AS cluster FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _claims(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_orderkey").alias("doc_id"), F.expr(_TRUST).cast("double").alias("trust_weight"), F.col("o_orderstatus").alias("regime"), (F.col("o_custkey") % 50).alias("evidence_cluster"))


@R.query(f"""WITH {_CLAIMS} SELECT substr(sha1(concat(src, chr(0), dst, chr(0), 'supply', chr(0), 'of', chr(0), '+', chr(0), regime, chr(0))), 1, 20) AS edge_id,
  src, dst, 'supply' AS family, 'of' AS type, '+' AS polarity, regime,
  count(DISTINCT doc_id) AS n_support, max(trust_weight) AS trust FROM c GROUP BY src, dst, regime""")
def corroborated_edges(spark, d):
    return graph.corroborate(_claims(spark, d).withColumns({"family": F.lit("supply"), "type": F.lit("of"), "polarity": F.lit("+")}))


@R.query(f"""WITH {_CLAIMS} SELECT src, doc_id, min(dst) AS seq, max_by(trust_weight, dst) AS trust_weight FROM (SELECT src, doc_id, dst, max(trust_weight) AS trust_weight FROM c GROUP BY 1, 2, 3) GROUP BY src, doc_id""")
def merged_support(spark, d):
    entries = _claims(spark, d).groupBy("src", "doc_id", F.col("dst").alias("seq")).agg(F.max("trust_weight").alias("trust_weight"))
    return graph.merge_support(entries, ["src"])


_EDGES = "e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS src, 100000 + l_partkey AS dst, l_shipdate AS updated_at, l_returnflag AS regime FROM lineitem WHERE l_linestatus = 'O')"


def _edges(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 100000).alias("dst"), F.col("l_shipdate").alias("updated_at"), F.col("l_returnflag").alias("regime"), F.when(F.col("l_linestatus") == "O", "active").otherwise("merged").alias("status"), F.lit("supply").alias("family"))


@R.query(f"""WITH {_EDGES}, b AS (SELECT src AS node, dst AS other, updated_at FROM e UNION ALL SELECT dst, src, updated_at
  FROM e), l AS (SELECT node, other, max(updated_at) AS updated_at FROM b GROUP BY 1, 2)
SELECT node, other, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY updated_at DESC, other) AS n FROM l) WHERE n <= 8""")
def node_neighbours(spark, d):
    return graph.neighbours(_edges(spark, d), 8)


@R.query(f"""WITH {_EDGES}, b AS (SELECT src AS node, dst AS other, updated_at FROM e UNION ALL SELECT dst, src, updated_at FROM e),
l AS (SELECT node, other, max(updated_at) AS updated_at FROM b GROUP BY 1, 2), c AS (SELECT DISTINCT 100000 + p_partkey AS other FROM part WHERE p_size > 25)
SELECT node, other, updated_at, other IN (SELECT other FROM c) AS has_card FROM l QUALIFY row_number() OVER (PARTITION BY node ORDER BY updated_at DESC, other) <= 8""")
def neighbours_with_cards(spark, d):
    """The latest neighbours, and whether they have an active card."""
    held = table(spark, d, "part").select((F.col("p_partkey") + 100000).alias("node_id"), F.when(F.col("p_size") > 25, "active").otherwise("stale").alias("status"))
    return graph.neighbours(_edges(spark, d), 8, held)


@R.query(f"WITH {_EDGES} SELECT id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY updated_at DESC, id) AS n FROM e) WHERE n <= 20")
def latest_claims(spark, d):
    return graph.edges_from(_edges(spark, d), 20).select("id", "src", "dst")


@R.query(f"WITH {_EDGES}, f AS (SELECT src, dst, regime, min(id) AS first FROM e GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT first, id FROM e JOIN f USING (src, dst, regime) WHERE id <> first")
def comparable_claims(spark, d):
    return graph.comparable_edges(_edges(spark, d))


@R.query(f"WITH {_CLAIMS}, n AS (SELECT src, regime, count(*) AS n FROM c GROUP BY 1, 2) SELECT src, regime FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, regime) AS k FROM n) WHERE k = 1")
def modal_regimes(spark, d):
    return graph.modal_regime(_claims(spark, d), "src")


@R.query(f"""WITH {_CLAIMS}, m AS (SELECT dst AS edge_id, sum(trust_weight) AS t FROM c GROUP BY 1), p AS (SELECT p_partkey AS a, p_partkey + 1 AS b
  FROM part), b AS (SELECT a AS edge, b AS against FROM p UNION SELECT b, a FROM p)
SELECT edge, round(round(sum(1 - exp(-t / 2)), 9), 6) AS pressure FROM b JOIN m ON edge_id = against GROUP BY edge""")
def contradiction_pressure(spark, d):
    pairs = table(spark, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    out = graph.contradiction_pressure(pairs, _claims(spark, d).withColumnRenamed("dst", "edge_id"))
    return out.withColumn("pressure", F.round("pressure", 6))


@R.query(f"""WITH {_CLAIMS}, k AS (SELECT dst, cluster, max(trust_weight) AS t FROM c GROUP BY 1, 2)
SELECT dst, round(greatest(0.0, least(1.0, 1 - exp(-round(sum(t), 9) / 2))), 6) AS strength FROM k GROUP BY dst""")
def evidence_strength(spark, d):
    return ask.strength(_claims(spark, d).withColumn("evidence_cluster", F.col("evidence_cluster").cast("string")).withColumn("doc_id", F.col("doc_id").cast("string")), "dst")


@R.query("""WITH n AS (SELECT p_partkey AS id, list_distinct(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: CASE
  WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND regexp_matches(w, '[sxzo]es$') THEN left(w,
  length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END)) AS s, p_size AS n_support FROM part
  WHERE p_size > 5),
c AS (SELECT p_partkey AS a, p_partkey + 1 AS b, (p_partkey % 100) / 100.0::DOUBLE AS similarity FROM part),
j AS (SELECT a, b, similarity, x.s AS sa, y.s AS sb, x.n_support AS na, y.n_support AS nb, len(list_intersect(x.s, y.s)) AS k FROM c LEFT
  JOIN n x ON x.id = a LEFT JOIN n y ON y.id = b),
r AS (SELECT *, CASE WHEN sa IS NULL OR sb IS NULL THEN 'stale' WHEN len(sa) > 0 AND len(sb) > 0 AND k = len(sa) AND k = len(sb) THEN 'same'
  WHEN len(sa) > 0 AND len(sb) > 0 AND k = len(sa) THEN 'b_is_a_a' WHEN len(sa) > 0 AND len(sb) > 0 AND k = len(sb) THEN 'a_is_a_b'
  WHEN len(sa) > 0 AND len(sb) > 0 AND similarity >= 0.93 AND k / (len(sa) + len(sb) - k) >= 0.5 THEN 'same' WHEN similarity >= 0.90 THEN 'escalate'
    ELSE 'deferred' END AS decision FROM j)
SELECT a, b, decision, CASE WHEN decision = 'same' THEN CASE WHEN na >= nb THEN a ELSE b END END AS survivor FROM r""")
def merge_queue(spark, d):
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_size").alias("n_support"), F.when(F.col("p_size") > 5, "active").otherwise("merged").alias("status"))
    queue = p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), ((F.col("p_partkey") % 100) / 100.0).cast("double").alias("similarity"))
    return graph.resolve_queue(queue, nodes)


@R.query(f"""WITH {_CLAIMS}, m AS (SELECT CASE WHEN src % 5 = 0 THEN src + 1 ELSE src END AS src, CASE WHEN dst % 5 = 0 THEN dst + 1
  ELSE dst END AS dst, regime, doc_id, trust_weight FROM c)
SELECT src, dst, regime, count(DISTINCT doc_id) AS n_support, max(trust_weight) AS trust FROM m WHERE src <> dst GROUP BY 1, 2, 3""")
def merged_nodes(spark, d):
    c = _claims(spark, d).withColumns({"family": F.lit("supply"), "type": F.lit("of"), "polarity": F.lit("+")})
    ids = c.select(F.col("src").alias("loser")).union(c.select("dst")).distinct().where("loser % 5 = 0")
    return graph.merge_nodes(c, ids.withColumn("survivor", F.col("loser") + 1)).select("src", "dst", "regime", "n_support", "trust")


# Where merges m (loser, survivor) end: of all nodes that they connect, one that never loses, then the one of most support n, then the smallest.
_SETTLED = """e AS (SELECT loser AS x, survivor AS y FROM m UNION SELECT survivor, loser FROM m),
r AS (SELECT x AS node, x AS reached FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reached),
g AS (SELECT node, min(reached) AS component FROM r GROUP BY node),
w AS (SELECT component, node AS survivor FROM g LEFT JOIN n ON n.id = node
  QUALIFY row_number() OVER (PARTITION BY component ORDER BY node IN (SELECT loser FROM m), -coalesce(n_support, 0), node) = 1),
z AS (SELECT node AS loser, survivor FROM g JOIN w USING (component) WHERE node <> survivor)"""
# Chains of twelve nodes of part, every other one closed to a cycle, and a star of all keys that 100 divides.
_CHAINS = """m AS (SELECT p_partkey AS loser, p_partkey + 1 AS survivor FROM part WHERE p_partkey % 12 <> 11 UNION SELECT p_partkey, p_partkey - 11 FROM part
  WHERE p_partkey % 24 = 11 UNION SELECT p_partkey, 0 FROM part WHERE p_partkey % 100 = 0 AND p_partkey > 0)"""


def _chains(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("loser"))
    parts = (p.where("loser % 12 <> 11").selectExpr("loser", "loser + 1 survivor"), p.where("loser % 24 = 11").selectExpr("loser", "loser - 11 survivor"), p.where("loser % 100 = 0 and loser > 0").selectExpr("loser", "0L survivor"))
    return parts[0].union(parts[1]).union(parts[2])


@R.query(f"WITH RECURSIVE {_CHAINS}, n AS (SELECT p_partkey AS id, p_size AS n_support FROM part), {_SETTLED} SELECT loser, survivor FROM z")
def settled_merges(spark, d):
    """Merges in chains and cycles, each to the node that it ends at."""
    return closure.settle(_chains(spark, d), table(spark, d, "part").selectExpr("p_partkey id", "p_size n_support"))


@R.query(f"""WITH RECURSIVE {_CHAINS}, n AS (SELECT 0 AS id, 0 AS n_support), {_SETTLED}, {_CLAIMS},
k AS (SELECT coalesce(a.survivor, src) AS src, coalesce(b.survivor, dst) AS dst, regime, doc_id, trust_weight FROM c LEFT JOIN z a ON a.loser = src LEFT
  JOIN z b ON b.loser = dst)
SELECT src, dst, regime, count(DISTINCT doc_id) AS n_support, max(trust_weight) AS trust FROM k WHERE src <> dst GROUP BY 1, 2, 3""")
def chain_merged_edges(spark, d):
    """Edges after merges in chains: each end is the node that its chain ends at."""
    c = _claims(spark, d).withColumns({"family": F.lit("supply"), "type": F.lit("of"), "polarity": F.lit("+")})
    return graph.merge_nodes(c, _chains(spark, d)).select("src", "dst", "regime", "n_support", "trust")


@R.query(f"""WITH RECURSIVE {_CHAINS}, n AS (SELECT 0 AS id, 0 AS n_support), {_SETTLED},
t AS (SELECT DISTINCT coalesce(survivor, l_partkey) AS id, l_orderkey FROM lineitem LEFT JOIN z ON loser = l_partkey), s AS (SELECT id, count(*) AS n FROM t GROUP BY id)
SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT loser FROM z) THEN 'merged' ELSE 'active' END AS status, coalesce(s.n, 0) AS n_support
FROM part LEFT JOIN s ON s.id = p_partkey""")
def chain_merged_rows(spark, d):
    """Nodes and the documents that they have after merges in chains."""
    p = table(spark, d, "part")
    marked, support, _ = cards.merge_node_rows(p.selectExpr("p_partkey id", "p_name label", "'active' status"), table(spark, d, "lineitem").selectExpr("l_partkey id", "l_orderkey doc_id"), p.selectExpr("p_partkey id", "p_brand alias"), _chains(spark, d))
    return marked.join(support.groupBy("id").agg(F.count("*").alias("n_support")), "id", "left").select("id", "status", F.coalesce("n_support", F.lit(0).cast("long")).alias("n_support"))


_DOT = "round(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 9)"


@R.query(f"""WITH s AS (SELECT b.vec_id AS a, a.vec_id AS b, {_DOT} AS similarity FROM embeddings a, embeddings b
  WHERE b.label = 0 AND a.vec_id <> b.vec_id AND abs(a.vec_id - b.vec_id) <> 1)
SELECT a, b, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS n FROM s
  WHERE similarity >= 0.2) WHERE n <= 3""")
def reconcile_neighbours(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    known = v.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return graph.knn_pairs(v, v.where("label = 0"), 3, 0.2, known).withColumn("similarity", F.round("similarity", 6))


@R.query("SELECT lower(trim(event_type)) AS question, count(*) AS misses, max(event_id) AS last FROM events WHERE value < 20 GROUP BY 1")
def gap_log(spark, d):
    return graph.gap_log(table(spark, d, "events").where("value < 20").select(F.col("event_type").alias("question"), F.col("event_id").alias("at")))


@R.query("""WITH q AS (SELECT DISTINCT p_partkey * 3 AS id FROM part), n AS (SELECT p_partkey AS id, p_brand AS label FROM part),
k AS (SELECT l_partkey AS id, list_sort(list_distinct(list(l_suppkey))) AS cards FROM lineitem JOIN n ON n.id = l_partkey AND starts_with(label, 'Brand#1') GROUP BY 1)
SELECT q.id, n.id IS NOT NULL AS annotated, coalesce(cards, []) AS cards FROM q LEFT JOIN n ON n.id = q.id LEFT JOIN k ON k.id = q.id""")
def annotated_ids(spark, d):
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    cards = li.select(F.col("l_partkey").alias("node_id"), F.col("l_suppkey").alias("card_id")).distinct()
    return graph.annotate(p.select((F.col("p_partkey") * 3).alias("id")), nodes, cards, "Brand#1")


@R.query("""WITH t AS (SELECT doc_id, n_chars % 100 / 100.0::DOUBLE AS score, doc_id % 4 AS n_support, CASE doc_id % 3 WHEN 0 THEN 'card' WHEN 1 THEN 'chunk'
  ELSE 'edge' END AS kind, doc_id % 17 = 0 AS contradicted FROM documents),
c AS (SELECT *, least(1.0, 0.5 * score + 0.3 * least(1.0, n_support / 2) + CASE WHEN kind IN ('node', 'edge', 'card') THEN 0.2 ELSE 0.0 END) AS conf FROM t)
SELECT doc_id, floor(conf * 10000 + 0.5) / 10000 AS confidence, CASE WHEN contradicted THEN 'contra' WHEN conf >= 0.66 THEN 'high'
  WHEN conf >= 0.40 THEN 'medium' WHEN conf > 0 THEN 'low' ELSE 'none' END AS band,
  CASE WHEN contradicted THEN 4 WHEN conf >= 0.66 THEN 1 WHEN conf >= 0.40 THEN 2 WHEN conf > 0 THEN 3 ELSE 4 END AS tier FROM c""")
def confidence_bands(spark, d):
    top = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 100 / 100.0).alias("score"), (F.col("doc_id") % 4).alias("n_support"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'card' WHEN 1 THEN 'chunk' ELSE 'edge' END").alias("kind"), (F.col("doc_id") % 17 == 0).alias("contradicted"))
    return ask.grounding(top).select("doc_id", "confidence", "band", ask.tier(F.col("band")).alias("tier"))


@R.query("""WITH w AS (SELECT DISTINCT user_id AS query_id, event_type AS feature, event_id % 3 AS value FROM events
  WHERE user_id % 50 = 0), h AS (SELECT DISTINCT user_id AS id, event_type AS feature, event_id % 3 AS value FROM events),
n AS (SELECT query_id, count(DISTINCT feature) AS n FROM w GROUP BY 1), m AS (SELECT query_id, id, w.feature, max((w.value = h.value)::INT) AS m
  FROM w JOIN h USING (feature) GROUP BY 1, 2, 3)
SELECT query_id, id, round(greatest(0.0, (sum(m) - 0.5 * sum(1 - m)) / (n + 1e-6)), 6) AS overlap FROM m JOIN n USING (query_id) GROUP BY query_id, id, n""")
def feature_overlap(spark, d):
    e = table(spark, d, "events")
    rows = lambda k: (F.col("user_id").alias(k), F.col("event_type").alias("feature"), (F.col("event_id") % 3).alias("value"))
    return ask.feature_overlap(e.where("user_id % 50 = 0").select(*rows("query_id")).distinct(), e.select(*rows("id")).distinct())


@R.query("""WITH f AS (SELECT DISTINCT doc_id AS id, lang AS value FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = d.doc_id AND value NOT IN ('en', 'fr')) AND source <> 'src7'""")
def facet_filtered(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    facets = docs.where("id % 3 <> 0").select("id", F.lit("lang").alias("axis"), F.col("lang").alias("value")).union(docs.select("id", F.lit("source"), "source")).distinct()
    return ask.facet_filter(docs.select("id"), facets, {"lang": ["en", "fr"]}, {"source": ["src7"]})


@R.query("SELECT 'lang' AS axis, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facet_counts(spark, d):
    docs = table(spark, d, "documents")
    return ask.facet_counts(docs.select(F.lit("lang").alias("axis"), F.col("lang").alias("value")).unionAll(docs.select(F.lit("source"), "source")))


@R.query(f"WITH {_CLAIMS} SELECT dst, 'trust_tier' AS axis, CASE WHEN max(trust_weight) >= 0.66 THEN 'high' WHEN max(trust_weight) >= 0.40 THEN 'medium' ELSE 'low' END AS value FROM c GROUP BY dst")
def trust_tiers(spark, d):
    return ask.trust_facets(_claims(spark, d), "dst")


@R.query("""WITH s AS (SELECT source, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS commercial, CASE WHEN doc_id % 50 = 3 THEN NULL
  ELSE doc_id % 40 = 5 END AS attribution, lang AS licence FROM documents)
SELECT source, CASE WHEN count(*) FILTER (NOT commercial) > 0 THEN false WHEN count(*) FILTER (commercial IS NULL) > 0 THEN NULL ELSE true END AS commercial,
  CASE WHEN count(*) FILTER (attribution) > 0 THEN true WHEN count(*) FILTER (attribution IS NULL) > 0 THEN NULL
    ELSE false END AS attribution, string_agg(DISTINCT licence, ' + ' ORDER BY licence) AS licences FROM s GROUP BY source""")
def combined_licences(spark, d):
    rows = table(spark, d, "documents").select("source", F.expr("CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END").alias("commercial"), F.expr("CASE WHEN doc_id % 50 = 3 THEN NULL ELSE doc_id % 40 = 5 END").alias("attribution"), F.col("lang").alias("licence"))
    return ask.combine_licences(rows, "source", ["commercial"], ["attribution"])


@R.query("""WITH r AS (SELECT label AS query_id, 'all' AS section, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS n FROM embeddings)
SELECT query_id, section, list(vec_id ORDER BY n) AS ids FROM r WHERE n <= 6 GROUP BY 1, 2""")
def answer_frames(spark, d):
    items = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.lit("all").alias("section"), F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).alias("score"))
    return ask.frame(items)


@R.query(f"WITH {_CLAIMS}, r AS (SELECT dst, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS k FROM c GROUP BY dst) SELECT dst, CASE WHEN k = n THEN 'all' WHEN k > 0 THEN 'some' ELSE 'none' END AS owned FROM r")
def ownership(spark, d):
    docs = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"))
    return provenance.ownership(_claims(spark, d), docs, "dst")


def _removal(spark, d):
    c = _claims(spark, d)
    docs = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"))
    # A number made of both ends would be that of other ends, too, once there are a million of them.
    edge = F.struct("src", "dst").alias("edge_id")
    edges, support = c.select(edge, "src", "dst").distinct(), c.select(edge, "doc_id").distinct()
    nodes = c.select(F.col("dst").alias("node"), "doc_id").distinct()
    return edges, support, nodes, docs


@R.query(f"WITH {_CLAIMS} SELECT src * 1000000 + dst AS edge_id, count(DISTINCT doc_id) FILTER (doc_id % 3 <> 0) AS n_support FROM c GROUP BY 1 HAVING count(*) FILTER (doc_id % 3 <> 0) > 0")
def removed_documents(spark, d):
    left, support, _ = provenance.remove_docs(*_removal(spark, d))
    rows = left.join(support, "edge_id").select((F.col("src") * 1000000 + F.col("dst")).alias("edge_id"), "doc_id")
    return rows.groupBy("edge_id").agg(F.countDistinct("doc_id").alias("n_support"))


@R.query(f"""WITH {_CLAIMS}, m AS (SELECT DISTINCT dst AS node FROM c WHERE doc_id % 3 = 0), e AS (SELECT DISTINCT src, dst FROM c
  WHERE doc_id % 3 = 0), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, false AS borrowed FROM m UNION ALL SELECT node, true FROM n WHERE node NOT IN (SELECT node FROM m)""")
def bundle_closure(spark, d):
    return provenance.closure(*_removal(spark, d))


@R.query("SELECT o_orderkey AS doc_id, o_orderstatus AS bundle FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderkey <> 7 AND o_orderpriority <> '5-LOW'")
def selected_sources(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("bundle"), F.col("o_orderpriority").alias("title"), F.lit("active").alias("status"))
    return provenance.select_sources(s, ["O", "F"], ["7", "5-LOW"]).select("doc_id", "bundle")


@R.query("SELECT s_suppkey AS doc_id, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE 'new' END AS bundle, CASE WHEN s_suppkey % 2 = 0 THEN 0.8 ELSE 0.35 END::DOUBLE AS trust_weight FROM supplier")
def imported_bundle(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("title"), F.lit("own").alias("bundle"), F.lit(0.8).alias("trust_weight"))
    return provenance.import_bundle(s.where("doc_id % 2 = 0"), s, "new")


@R.query("SELECT n_name AS bundle, count(*) AS n_sources, max(s_acctbal) AS trust, string_agg(DISTINCT s_name, chr(31) ORDER BY s_name) AS titles FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def bundle_summaries(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("bundle"), F.col("s_acctbal").alias("trust_weight"), F.col("s_name").alias("title"))
    return provenance.bundle_summary(rows)


_RULES = [
    {"edge_id": "r1", "subject": "REGION", "severity": "severe", "status": "ratified", "expr": {"op": "all_of", "args": [{"op": "presence", "pred": "BUILDING"}, {"op": "compare", "field": "balance", "cmp": "<", "operand": {"lit": 0}}]}},
    {"edge_id": "r2", "subject": "NATION", "severity": "caution", "status": "ratified", "expr": {"op": "any_of", "args": [{"op": "compare", "field": "balance", "cmp": ">", "operand": {"field": "limit"}}, {"op": "absence", "pred": "BUILDING"}]}},
    {"edge_id": "r3", "subject": "NATION", "severity": "prohibitive", "status": "proposed", "expr": {"op": "not", "arg": {"op": "presence", "pred": "MACHINERY"}}},
]
_R1, _R2, _R3 = "(c_mktsegment = 'BUILDING' AND c_acctbal < 0)", "(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal > 5000 END OR c_mktsegment <> 'BUILDING')", "(c_mktsegment <> 'MACHINERY')"


@R.query(f"""WITH f AS (SELECT c_custkey AS state_id, 'r1' AS edge_id, 3 AS w, {_R1} AS r, false AS p FROM customer UNION ALL
  SELECT c_custkey, 'r2', 2, {_R2}, false FROM customer UNION ALL SELECT c_custkey, 'r3', 4, {_R3}, true FROM customer),
k AS (SELECT *, r IS NOT NULL AND NOT p AS fires FROM f WHERE r IS NULL OR r)
SELECT state_id, edge_id, CASE WHEN fires THEN 'fire' ELSE 'flag_for_human' END AS disposition, ['advisory', 'caution', 'severe',
  'prohibitive'][w] AS severity, CASE WHEN fires THEN ['note', 'warn', 'warn_strong', 'block'][w]
  ELSE 'human_review' END AS recommended, row_number() OVER (PARTITION BY state_id ORDER BY CASE WHEN fires THEN 0
  ELSE 1 END, w DESC, edge_id) AS rank FROM k""")
def rule_findings(spark, d):
    limit = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("balance"), "c_acctbal", F.lit("limit"), F.lit(5000.0))).otherwise(F.create_map(F.lit("balance"), "c_acctbal"))
    states = table(spark, d, "customer").select(F.col("c_custkey").alias("state_id"), F.lit("NATION").alias("action"), F.array("c_mktsegment").alias("predicates"), limit.alias("fields"))
    scopes = spark.createDataFrame([("NATION", "NATION"), ("NATION", "REGION")], "action string, node string")
    out = rules.check(states, scopes, _RULES)
    return out.select("state_id", "edge_id", "disposition", "severity", "recommended", F.col("rank").cast("long").alias("rank"))


@R.query("SELECT 'n' || n_nationkey AS action, x AS node FROM (SELECT n_nationkey, unnest(['n' || n_nationkey, 'r' || n_regionkey, 'world', 'g' || n_regionkey % 2]) AS x FROM nation)")
def scope_closure(spark, d):
    n = table(spark, d, "nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    is_a = n.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")).union(n.select(name("r", "n_regionkey"), F.lit("world"))).distinct()
    groups = n.select(name("r", "n_regionkey").alias("member"), F.concat(F.lit("g"), (F.col("n_regionkey") % 2).cast("string")).alias("grouper")).distinct()
    return rules.scope(n.select(name("n", "n_nationkey").alias("action")), is_a, spark.createDataFrame([], "action string, resource string"), groups)


@R.query("SELECT s_suppkey AS node, unnest(range(0, greatest(0, least(20, s_suppkey - 1)) + 1)) AS ancestor FROM supplier")
def deep_ancestors(spark, d):
    """Chains of up to twenty steps from each supplier."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.least(F.lit(20), F.col("s_suppkey") - 1).cast("int").alias("most"))
    name = lambda i: F.concat_ws("/", F.col("k").cast("string"), i.cast("string"))
    steps = s.select("k", "most", F.explode(F.sequence(F.lit(0), "most")).alias("i")).where("i < most")
    found = rules.ancestors(steps.select(name(F.col("i")).alias("child"), name(F.col("i") + 1).alias("parent")), s.select(name(F.lit(0)).alias("node")))
    part = lambda c, k: F.get(F.split(c, "/"), F.lit(k)).cast("long")
    return found.select(part("node", 0).alias("node"), part("ancestor", 1).alias("ancestor"))


_NOW = 1706659200.0  # 2024-01-31


@R.query(f"""WITH s AS (SELECT epoch(ts) AS ts, event_type AS series, value FROM events), b AS (SELECT series, floor((ts - ({_NOW} - 2592000)) / 4320) AS b,
  avg(value) AS v FROM s WHERE ts >= {_NOW} - 2592000 GROUP BY 1, 2)
SELECT series, round({_NOW} - 2592000 + (b + 0.5) * 4320, 1) AS at, floor(round(v, 9) * 1000 + 0.5) / 1000 AS value FROM b""")
def metric_history(spark, d):
    s = table(spark, d, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_type").alias("series"), "value")
    return telemetry.history(s, _NOW, 30 * 24 * 60)


@R.query(f"SELECT event_id FROM events WHERE epoch(ts) >= {_NOW} - 7 * 86400")
def pruned_samples(spark, d):
    s = table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return telemetry.prune(s, _NOW, 7).select("event_id")


@R.query("""SELECT * FROM (SELECT l_orderkey * 10 + l_linenumber AS ts, unnest(['l_quantity', 'l_discount', 'l_tax']) AS series, unnest([l_quantity, l_discount, CASE WHEN l_linenumber <> 3 THEN l_tax END]::DOUBLE[]) AS value
FROM lineitem) WHERE value IS NOT NULL""")
def long_samples(spark, d):
    """Wide rows as one row a series; nulls are left out."""
    li = table(spark, d, "lineitem")
    return telemetry.long_samples(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ts"), "l_quantity", "l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax")))


@R.query("""SELECT * FROM (SELECT event_id::VARCHAR AS gpu, unnest(['util', 'mem_used', 'mem_total', 'power', 'temp']) AS metric,
  unnest([user_id % 100, CASE WHEN user_id % 3 <> 0 THEN user_id END, 24000, 70, CASE WHEN event_id % 2 = 0 THEN 40 END]::DOUBLE[]) AS value FROM events) WHERE value IS NOT NULL""")
def gpu_samples(spark, d):
    """Comma-separated lines of devices; values that are no numbers, or missing, are left out."""
    e, text = table(spark, d, "events"), lambda c: F.col(c).cast("string")
    fields = [text("event_id"), (F.col("user_id") % 100).cast("string"), F.when(F.col("user_id") % 3 == 0, "[N/A]").otherwise(text("user_id")), F.lit("24000"), F.lit("70"), F.when(F.col("event_id") % 2 == 0, "40")]
    return telemetry.gpu_rows(e.select(F.concat_ws(", ", *[F.coalesce(f, F.lit("")) for f in fields]).alias("line")))


@R.query("""WITH s AS (SELECT user_id AS job, event_id AS ts, value > 50 AS running FROM events), l AS (SELECT *, coalesce(lag(running) OVER (PARTITION BY job
  ORDER BY ts), false) AS was FROM s)
SELECT job, ts, CASE WHEN running THEN 'start' ELSE 'end' END AS kind FROM l WHERE running <> was""")
def job_transitions(spark, d):
    return telemetry.transitions(table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("ts"), (F.col("value") > 50).alias("running")))


@R.query("""SELECT event_type AS rule, count(*) AS requests, sum(user_id)::BIGINT AS bytes, count(*) FILTER (value < 10) AS denied, count(*) FILTER (value >= 90) AS auth_rejects, max(event_id) AS last_ts, max_by(props, event_id) AS last_purpose FROM events GROUP BY 1""")
def audit_rollup(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("rule"), F.col("user_id").alias("bytes"), F.when(F.col("value") < 10, "denied").when(F.col("value") >= 90, "auth").otherwise("ok").alias("outcome"), F.col("event_id").alias("ts"), F.col("props").alias("purpose"))
    return telemetry.audit_rollup(log)


@R.query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_tail(spark, d):
    return telemetry.tail(table(spark, d, "events"), 50).select("event_id", "event_type")


_RANKED = "r AS (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rank FROM events), j AS (SELECT user_id AS query_id, event_id AS id, (event_id % 4)::INT AS grade FROM events WHERE event_id % 3 = 0)"


def _ranked(spark, d):
    from lorewell.operators.search import top_k

    e = table(spark, d, "events")
    results = top_k(e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score")), 1 << 30)
    return results, e.where("event_id % 3 = 0").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), (F.col("event_id") % 4).cast("int").alias("grade"))


@R.query(f"WITH {_RANKED} SELECT j.query_id, round(count(*) FILTER (rank < 20) / count(*), 6) AS recall FROM j JOIN r ON r.query_id = j.query_id AND r.id = j.id WHERE grade >= 2 GROUP BY 1")
def recall_at_20(spark, d):
    return evaluate.recall_at_k(*_ranked(spark, d), 20)


@R.query(f"""WITH {_RANKED}, g AS (SELECT r.query_id, sum((2.0 ** coalesce(grade, 0) - 1) / log2(rank + 2)) AS dcg FROM r LEFT
  JOIN j ON r.query_id = j.query_id AND r.id = j.id WHERE rank < 10 GROUP BY 1),
i AS (SELECT query_id, sum((2.0 ** grade - 1) / log2(n + 1)) AS idcg, max(grade) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY grade DESC, id) AS n FROM j) WHERE n <= 10 GROUP BY 1)
SELECT i.query_id, round(coalesce(dcg, 0.0) / idcg, 6) AS ndcg FROM i LEFT JOIN g USING (query_id) WHERE best >= 2""")
def ndcg_at_10(spark, d):
    return evaluate.ndcg_at_k(*_ranked(spark, d), 10)


@R.query("""WITH o AS (SELECT (doc_id % 4 + 1)::INT AS tier, quality * 2 AS top_grade, quality = 1 AS answerable, toxic = 1 AS outside FROM labels),
s AS (SELECT count(*) AS n, coalesce(round(count(*) FILTER (top_grade <= 1 AND tier = 1) / nullif(count(*) FILTER (tier = 1), 0), 4),
  0.0) AS false_confidence, round(count(*) FILTER (tier >= 3 AND outside) / nullif(count(*) FILTER (outside), 0), 4) AS outside_correct,
  round(count(*) FILTER (tier >= 3 AND answerable) / nullif(count(*) FILTER (answerable), 0), 4) AS overreach FROM o)
SELECT *, false_confidence <= 0.02 AND coalesce(outside_correct, 1.0) >= 0.9 AS accepted FROM s""")
def abstention_rates(spark, d):
    rows = table(spark, d, "labels").select((F.col("doc_id") % 4 + 1).alias("tier"), (F.col("quality") * 2).alias("top_grade"), (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 1).alias("outside"))
    return evaluate.abstention(rows)


@R.query("SELECT event_type, round(quantile_cont(value, 0.5), 1) AS p50, round(quantile_cont(value, 0.95), 1) AS p95, count(*) AS n FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return evaluate.percentiles(table(spark, d, "events"), "event_type", "value")


# Relations, and the family, type and polarity that claims of them have.
_RELS = {"IsA": ("taxonomic", "is_a", ""), "RelatedTo": ("associative", "related_to", ""), "UsedFor": ("functional", "used_for", ""), "Causes": ("causal", "causes", "positive"), "NotDesires": ("affective", "desires", "negative"), "HasContext": ("lexical", "has_context", ""), "dbpedia": (None, None, None), "LocatedNear": ("spatial", "located_near", "")}
_REL_SQL = f"{list(_RELS)}[l_partkey % 8 + 1]"
_SPEC = lambda k: "CASE r " + " ".join(f"WHEN '{n}' THEN '{v[k]}'" for n, v in _RELS.items() if v[k] is not None) + " END"


@R.query(f"""WITH a AS (SELECT 'u' || l_orderkey * 10 + l_linenumber AS uri, {_REL_SQL} AS r, CASE WHEN l_suppkey % 10 = 0 THEN 'fr'
  ELSE 'en' END AS lang, 'part ' || l_partkey % 50 AS src, 'part ' || l_suppkey % 50 AS dst, l_quantity AS weight FROM lineitem),
w AS (SELECT *, CASE WHEN lang <> 'en' THEN 'language' WHEN r = 'dbpedia' THEN 'unknown' WHEN r = 'Causes' THEN 'excluded'
  WHEN r IN ('RelatedTo', 'HasContext') THEN 'lexical' WHEN weight < 5 THEN 'weight' WHEN src = dst THEN 'loop' ELSE 'kept' END AS why FROM a),
o AS (SELECT *, CASE WHEN why = 'kept' AND row_number() OVER (PARTITION BY r, src, dst, why ORDER BY uri) > 1 THEN 'repeat' ELSE why END AS outcome FROM w)
SELECT '/r/' || r AS rel, {_SPEC(0)} AS family, {_SPEC(1)} AS type, {_SPEC(2)} AS polarity, outcome, count(*) AS n FROM o GROUP BY ALL""")
def imported_assertions(spark, d):
    li = table(spark, d, "lineitem")
    term = lambda c, lang: F.concat(F.lit("/c/"), lang, F.lit("/part_"), (F.col(c) % 50).cast("string"), F.lit("/n"))
    rel = F.concat(F.lit("/r/"), F.array(*map(F.lit, _RELS))[(F.col("l_partkey") % 8).cast("int")])
    rows = li.select(F.concat(F.lit("u"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")).alias("uri"), rel.alias("rel"), term("l_partkey", F.when(F.col("l_suppkey") % 10 == 0, "fr").otherwise("en")).alias("start"), term("l_suppkey", F.lit("en")).alias("end"), F.to_json(F.struct(F.col("l_quantity").alias("weight"))).alias("info"))
    return importers.assertions(rows, 5.0, ["Causes"]).groupBy("rel", "family", "type", "polarity", "outcome").agg(F.count("*").alias("n"))


@R.query("""WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS tokens FROM documents),
b AS (SELECT item_id AS alias_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
a AS (SELECT DISTINCT alias_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS seq FROM b),
g AS (SELECT id, i - 1 AS pos, array_to_string(tokens[i:i + 2], chr(31)) AS g FROM t, range(1, 100000) r(i) WHERE i <= len(tokens) - 2)
SELECT id, pos, alias_id FROM g JOIN a ON array_to_string(seq, chr(31)) = g""")
def alias_hits(spark, d):
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("alias_id"), words.alias("w")).where(F.size("w") >= 3)
    aliases = items.select("alias_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.slice("w", i, 3))).alias("seq")).distinct()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), words.alias("tokens"))
    return lexicon.match_tokens(docs, aliases).withColumn("pos", F.col("pos").cast("long"))


@R.query()
def lexicon_spans(spark, d):
    """Passages of the benchmark, in runs of three words, as aliases in all documents, exact and corrected; tests hold the matcher against goldens.

    A passage of fewer words is one alias, unless the lexicon refuses it (a lone stopword or a form of two letters).
    """
    aliases = []
    for r in table(spark, d, "benchmark").orderBy("item_id", "text").select("item_id", "text").toLocalIterator():
        own = [lexicon.Alias(len(aliases) + i, f"n{r['item_id']}", run) for i, run in enumerate(lexicon.runs(r["text"] or "", 3))]
        if not any(level == "ERROR" for level, *_ in lexicon.findings(own)):
            aliases += own
    return lexicon.match_texts(table(spark, d, "documents").select("doc_id", "text"), aliases, "doc_id")
