"""Queries of cards, answers, facets, bundles and what is done with verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import answers, ask, cards, context, library, provenance
from lorewell.plans import text_queries
from lorewell.plans.registry import Registry, table

R = Registry()

# Parts are cards: a brand is a concept, a type the title, and the words of the name the steps.
_STEPS = "'[' || array_to_string(list_transform(string_split(p_name, ' '), lambda x: '\"' || x || '\"'), ', ') || ']'"
_CARD = "concat('card', chr(0), p_brand, chr(0), p_type, chr(0), 'goal ' || p_size % 5, chr(0), {steps}, chr(0){more})"
_HASH = f"substr(sha1(CASE WHEN p_size % 4 = 0 THEN {_CARD.format(steps=_STEPS, more=', ' + repr('criteria') + ', chr(0), ' + repr('{}') + ', chr(0)')} ELSE {_CARD.format(steps=_STEPS, more='')} END), 1, 20)"
_DRAFTS = f"c AS (SELECT p_partkey, p_size, p_type, p_brand, {_HASH} AS h FROM part)"


def _drafts(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 4 == 0, "Criteria").otherwise("procedure")
    return p.select(F.col("p_brand").alias("node_id"), F.col("p_type").alias("title"), F.concat(F.lit("goal "), (F.col("p_size") % 5).cast("string")).alias("goal"), F.split("p_name", " ").alias("steps"), kind.alias("card_type"), F.lit(None).cast("string").alias("criteria"), F.col("p_partkey").cast("string").alias("doc_id"), (F.col("p_size") / 100).alias("trust_weight"))


def _known_cards(spark, d):
    own = _drafts(spark, d).where("doc_id % 3 = 0")
    h = cards.card_hash(*[F.col(c) for c in ("node_id", "title", "goal", "steps", "card_type", "criteria")])
    rows = own.withColumn("card_hash", h)
    known = rows.groupBy("card_hash").agg(*[F.min_by(c, "doc_id").alias(c) for c in ("node_id", "title", "goal", "steps", "card_type", "criteria")])
    return known.select(F.col("card_hash").alias("card_id"), "*", F.lit("active").alias("status")), rows.select(F.col("card_hash").alias("card_id"), "doc_id", "trust_weight")


@R.query(f"""WITH {_DRAFTS}, k AS (SELECT DISTINCT h FROM c WHERE p_partkey % 3 = 0)
SELECT h AS card_id, CASE WHEN h IN (SELECT h FROM k) THEN 'corroborate' ELSE 'insert' END AS action, count(*) AS drafts, (SELECT count(*) FROM c x
  WHERE x.h = c.h) AS n_support FROM c WHERE p_partkey % 3 <> 0 GROUP BY h""")
def added_cards(spark, d):
    known, support = _known_cards(spark, d)
    _, merged, actions = cards.add_cards(known, support, _drafts(spark, d).where("doc_id % 3 <> 0"))
    return actions.join(merged.groupBy("card_id").agg(F.count("*").alias("n_support")), "card_id")


@R.query(f"""WITH {_DRAFTS}, k AS (SELECT h, min_by(p_partkey, p_partkey::VARCHAR) AS k FROM c WHERE p_partkey % 3 = 0 GROUP BY h)
SELECT h AS card_id, CASE WHEN p_partkey % 2 = 0 THEN repeat('new ', 125) ELSE p_type END AS title, p_partkey % 2 = 1 AS same FROM k JOIN part ON p_partkey = k""")
def refreshed_cards(spark, d):
    """Every other card has a new title, longer than a title may be."""
    known, support = _known_cards(spark, d)
    even = support.groupBy("card_id").agg(F.min("doc_id").alias("k")).where("k % 2 = 0").select("card_id", F.repeat(F.lit("new "), F.lit(200)).alias("title"))
    return cards.refresh_cards(known, even).select("card_id", "title", (F.col("card_hash") == F.col("card_id")).alias("same"))


@R.query("""WITH i AS (SELECT p_partkey % 4 AS k, p_partkey AS id FROM part),
n AS (SELECT s_suppkey AS id, s_name AS label, 'at ' || s_nationkey AS text, s_suppkey % 5 <> 0 AS live FROM supplier)
SELECT 'node' AS kind, n.id::VARCHAR AS id, label, text, 'empirical' AS regime, NULL AS node_id FROM i JOIN n ON n.id = i.id WHERE k = 0 AND live
UNION ALL SELECT 'edge', o_orderkey::VARCHAR, NULL, o_orderpriority, 'fictional', NULL FROM i JOIN orders ON o_orderkey = i.id WHERE k = 1 AND o_orderstatus <> 'F'
UNION ALL SELECT 'card', p_partkey::VARCHAR, p_name, p_type, NULL, p_brand FROM i JOIN part ON p_partkey = i.id WHERE k = 2""")
def hydrated_items(spark, d):
    """Items of four kinds, one of which is none, with the texts of active rows."""
    kind = F.array(*map(F.lit, ["node", "edge", "card", "chunk"]))[(F.col("p_partkey") % 4).cast("int")]
    items = table(spark, d, "part").select(kind.alias("kind"), F.col("p_partkey").alias("id"))
    nodes = table(spark, d, "supplier").selectExpr("s_suppkey id", "s_name label", "concat('at ', s_nationkey) summary", "'empirical' regime", "case when s_suppkey % 5 <> 0 then 'active' else 'merged' end status")
    edges = table(spark, d, "orders").selectExpr("o_orderkey id", "o_orderpriority brief", "'fictional' regime", "case when o_orderstatus <> 'F' then 'active' else 'retracted' end status")
    own = table(spark, d, "part").selectExpr("p_partkey card_id", "p_name title", "p_type goal", "cast(null as string) regime", "p_brand node_id", "'active' status")
    return cards.hydrate(items, nodes, edges, own)


@R.query("""WITH c AS (SELECT p_brand AS node_id, p_partkey AS card_id FROM part WHERE p_size % 3 <> 0)
SELECT node_id, card_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY card_id) AS n FROM c) WHERE n <= 10""")
def cards_of_nodes(spark, d):
    p = table(spark, d, "part")
    own = p.selectExpr("p_brand node_id", "p_partkey card_id", "case when p_size % 3 <> 0 then 'active' else 'merged' end status")
    return cards.cards_for(p.select(F.col("p_brand").alias("node_id")), own)


@R.query("""SELECT o_orderkey AS edge_id, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN o_orderpriority ELSE o_orderstatus END AS stage, CASE WHEN o_orderkey % 3 <> 0 THEN 'x' END AS more FROM orders""")
def enriched_edges(spark, d):
    o = table(spark, d, "orders")
    edges = o.select(F.col("o_orderkey").alias("edge_id"), F.create_map(F.lit("stage"), "o_orderstatus").alias("modifiers"))
    stage = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise("")
    new = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("edge_id"), F.create_map(F.lit("stage"), stage, F.lit("more"), F.lit("x")).alias("modifiers"))
    out = cards.enrich_edges(edges, new)
    return out.select("edge_id", F.col("modifiers")["stage"].alias("stage"), F.try_element_at("modifiers", F.lit("more")).alias("more"))


@R.query("""SELECT DISTINCT substr(sha1(concat(p_partkey % 100, chr(0), p_size, chr(0), 'meta', chr(0), 'refines', chr(0), '', chr(0), 'meta', chr(0))), 1, 20) AS edge_id, p_partkey % 100 AS src, p_size AS dst FROM part""")
def meta_links(spark, d):
    return cards.link_meta(table(spark, d, "part").selectExpr("p_partkey % 100 a", "p_size b", "'refines' type")).select("edge_id", "src", "dst")


# A queue of pairs of parts, of which small ones are gone; sizes are their support.
_QUEUE = "q AS (SELECT p_partkey AS a, p_partkey + 1 AS b, CASE WHEN p_partkey % 6 = 5 THEN 'closed' ELSE 'open' END AS status, ['same', 'a_is_a_b', 'b_is_a_a', 'distinct', 'unsure'][p_partkey % 5 + 1] AS decision FROM part), n AS (SELECT p_partkey AS id, p_size AS n FROM part WHERE p_size > 8)"


def _queue(spark, d):
    p = table(spark, d, "part")
    decision = F.array(*map(F.lit, ["same", "a_is_a_b", "b_is_a_a", "distinct", "unsure"]))[(F.col("p_partkey") % 5).cast("int")]
    queue = p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), F.lit(0.9).alias("similarity"), F.expr("case when p_partkey % 6 = 5 then 'closed' else 'open' end").alias("status"))
    nodes = p.selectExpr("p_partkey id", "p_name label", "p_size n_support", "case when p_size > 8 then 'active' else 'merged' end status")
    return queue, p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), decision.alias("decision")), nodes


@R.query(f"""WITH {_QUEUE}, r AS (SELECT q.a, q.b, decision, x.n AS na, y.n AS nb FROM q LEFT JOIN n x ON x.id = q.a LEFT JOIN n y ON y.id = q.b WHERE status = 'open')
SELECT a, b, CASE WHEN na IS NULL OR nb IS NULL THEN 'stale' WHEN decision = 'same' THEN 'merged' WHEN decision LIKE '%is_a%' THEN 'is_a' ELSE 'distinct' END AS outcome,
  CASE WHEN na IS NOT NULL AND nb IS NOT NULL AND decision = 'same' THEN CASE WHEN na > nb THEN a ELSE b END END AS survivor, CASE
    WHEN na IS NOT NULL AND nb IS NOT NULL AND decision = 'same' THEN CASE WHEN na > nb THEN b ELSE a END END AS loser,
  CASE WHEN na IS NOT NULL AND nb IS NOT NULL AND decision LIKE '%is_a%' THEN CASE decision WHEN 'b_is_a_a' THEN b ELSE a END END AS src, CASE
    WHEN na IS NOT NULL AND nb IS NOT NULL AND decision LIKE '%is_a%' THEN CASE decision WHEN 'b_is_a_a' THEN a ELSE b END END AS dst FROM r""")
def applied_verdicts(spark, d):
    return cards.apply_verdicts(*_queue(spark, d))


@R.query(f"WITH {_QUEUE} SELECT a, b, CASE WHEN status = 'open' AND (a NOT IN (SELECT id FROM n) OR b NOT IN (SELECT id FROM n)) THEN 'stale' ELSE status END AS status FROM q")
def open_candidates(spark, d):
    queue, _, nodes = _queue(spark, d)
    return cards.open_candidates(queue, nodes).select("a", "b", "status")


_MERGED = "m AS (SELECT p_partkey AS loser, p_partkey + 1 AS survivor FROM part WHERE p_partkey % 4 = 0)"


@R.query(f"""WITH {_MERGED}, t AS (SELECT DISTINCT coalesce(survivor, l_partkey) AS id, l_orderkey AS doc FROM lineitem LEFT
  JOIN m ON loser = l_partkey), s AS (SELECT id, count(*) AS n FROM t GROUP BY id),
a AS (SELECT DISTINCT coalesce(survivor, p_partkey) AS id, alias FROM (SELECT p_partkey, p_brand AS alias FROM part UNION ALL SELECT p_partkey, p_name
  FROM part WHERE p_partkey % 4 = 0) LEFT JOIN m ON loser = p_partkey),
k AS (SELECT a.id, count(*) AS n FROM a LEFT JOIN part p ON p.p_partkey = a.id AND p.p_name = a.alias WHERE p.p_partkey IS NULL GROUP BY a.id)
SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'merged' ELSE 'active' END AS status, coalesce(s.n, 0) AS n_support, coalesce(k.n,
  0) AS n_aliases FROM part LEFT JOIN s ON s.id = p_partkey LEFT JOIN k ON k.id = p_partkey""")
def merged_node_rows(spark, d):
    """Nodes after merges, with the documents and other names that they have."""
    p = table(spark, d, "part")
    nodes, aliases = p.selectExpr("p_partkey id", "p_name label", "'active' status"), p.selectExpr("p_partkey id", "p_brand alias")
    merged = p.where("p_partkey % 4 = 0").selectExpr("p_partkey loser", "p_partkey + 1 survivor")
    marked, support, names = cards.merge_node_rows(nodes, table(spark, d, "lineitem").selectExpr("l_partkey id", "l_orderkey doc_id"), aliases, merged)
    count = lambda rows, c: rows.groupBy("id").agg(F.count("*").alias(c))
    return marked.join(count(support, "n_support"), "id", "left").join(count(names, "n_aliases"), "id", "left").select("id", "status", F.coalesce("n_support", F.lit(0).cast("long")).alias("n_support"), F.coalesce("n_aliases", F.lit(0).cast("long")).alias("n_aliases"))


@R.query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND event_id % 5 <> 0 THEN 'closed' WHEN event_id % 5 = 0 THEN 'dropped' ELSE 'open' END AS status FROM events")
def closed_gaps(spark, d):
    gaps = table(spark, d, "events").select("event_id", F.concat(F.lit(" "), F.upper("event_type")).alias("question"), F.when(F.col("event_id") % 5 == 0, "dropped").otherwise("open").alias("status"))
    return cards.close_gaps(gaps, spark.createDataFrame([("click ",), ("View",)], "question string")).select("event_id", "status")


# Items are orders; lines are their support, by suppliers, of which some are bulk imports.
_SUPPORT = "s AS (SELECT l_orderkey AS id, l_suppkey AS doc, l_suppkey % 3 = 0 AS bulk, CASE WHEN l_linenumber % 2 = 0 OR l_suppkey % 5 < 3 THEN 'research' END AS provenance, CASE l_returnflag WHEN 'A' THEN 'fictional' WHEN 'R' THEN 'empirical' END AS origin FROM lineitem)"


def _support(spark, d):
    return table(spark, d, "lineitem").selectExpr("'card' kind", "cast(l_orderkey as string) id", "cast(l_suppkey as string) doc_id", "case when l_linenumber % 2 = 0 or l_suppkey % 5 < 3 then 'research' end provenance", "case l_returnflag when 'A' then 'fictional' when 'R' then 'empirical' end origin")


@R.query(f"WITH {_SUPPORT} SELECT 'card' AS kind, id::VARCHAR AS id, (CASE WHEN bool_and(bulk) THEN 0.5 ELSE 1.0 END * CASE WHEN bool_and(provenance IS NOT NULL) THEN 0.85 ELSE 1.0 END)::DOUBLE AS factor FROM s GROUP BY s.id")
def trust_factors(spark, d):
    return answers.trust_factors(_support(spark, d), table(spark, d, "supplier").where("s_suppkey % 3 = 0").selectExpr("cast(s_suppkey as string) doc_id"))


_ITEMS = "i AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'fictional' WHEN 1 THEN 'empirical' WHEN 2 THEN 'interpretive' END AS regime FROM orders)"


def _items(spark, d):
    return table(spark, d, "orders").selectExpr("'card' kind", "cast(o_orderkey as string) id", "case o_orderkey % 4 when 0 then 'fictional' when 1 then 'empirical' when 2 then 'interpretive' end regime")


@R.query(f"WITH {_ITEMS} SELECT id::VARCHAR AS id FROM i WHERE coalesce(regime, 'empirical') IN ('empirical', 'historical')")
def science_items(spark, d):
    return answers.mode_filter(_items(spark, d), _support(spark, d), "science").select("id")


@R.query(f"WITH {_ITEMS}, {_SUPPORT}, o AS (SELECT id, bool_or(origin = 'fictional') AS ok FROM s WHERE origin IS NOT NULL GROUP BY id) SELECT i.id::VARCHAR AS id FROM i LEFT JOIN o ON o.id = i.id WHERE coalesce(ok, coalesce(regime, 'empirical') IN ('fictional', 'interpretive', 'conventional'))")
def strict_fiction_items(spark, d):
    return answers.mode_filter(_items(spark, d), _support(spark, d), "fiction", strict=True).select("id")


@R.query(f"WITH {_ITEMS} SELECT id::VARCHAR AS id, CASE regime WHEN 'fictional' THEN 'In the work: ' WHEN 'interpretive' THEN 'An argued position: ' ELSE '' END || id AS text FROM i")
def framed_texts(spark, d):
    return _items(spark, d).select("id", answers.framed(F.col("regime"), F.col("id")).alias("text"))


@R.query("""WITH i AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN ' Historical' WHEN 1 THEN 'odd' END AS regime, CASE
  WHEN p_size % 7 = 0 THEN 'superseded' ELSE 'active' END AS status, CASE WHEN p_size % 3 = 0 THEN 0.0 WHEN p_size % 3 = 1 THEN 0.5 END AS volatility
  FROM part),
s AS (SELECT l_partkey AS id, l_suppkey AS doc, (l_quantity / 50)::DOUBLE AS t, CASE l_returnflag WHEN 'A' THEN 'fictional' WHEN 'R' THEN 'empirical'
  ELSE 'x' END AS regime FROM lineitem),
k AS (SELECT id, regime, count(*) AS n FROM s WHERE regime <> 'x' GROUP BY 1, 2), m AS (SELECT id, regime AS modal FROM k
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, regime) = 1),
b AS (SELECT DISTINCT s.id, lower(n_name) AS b FROM s JOIN supplier ON s_suppkey = doc JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey % 2 = 0)
SELECT i.id, 'epistemic' AS axis, coalesce(CASE WHEN regime = ' Historical' THEN 'historical' END, modal) AS value FROM i LEFT JOIN m USING (id)
  WHERE regime = ' Historical' OR modal IS NOT NULL
UNION ALL SELECT id, 'trust_tier', CASE WHEN max(t) >= 0.66 THEN 'high' WHEN max(t) >= 0.4 THEN 'medium' ELSE 'low' END FROM s GROUP BY id
UNION ALL SELECT id, 'domain', b FROM b
UNION ALL SELECT id, 'time_frame', CASE WHEN status = 'superseded' THEN 'superseded' WHEN regime = ' Historical' THEN 'historical'
  WHEN volatility <= 1e-6 THEN 'timeless' ELSE 'current' END FROM i
  WHERE status = 'superseded' OR regime = ' Historical' OR volatility <= 1e-6 OR id IN (SELECT id FROM s)""")
def derived_facets(spark, d):
    """The four facets of parts, from the lines that support them; nations of even number are subjects."""
    items = table(spark, d, "part").selectExpr("p_partkey id", "case p_size % 4 when 0 then ' Historical' when 1 then 'odd' end regime", "case when p_size % 7 = 0 then 'superseded' else 'active' end status", "cast(case when p_size % 3 = 0 then 0.0 when p_size % 3 = 1 then 0.5 end as double) volatility")
    support = table(spark, d, "lineitem").selectExpr("l_partkey id", "l_suppkey doc_id", "l_quantity / 50 trust_weight", "case l_returnflag when 'A' then 'Fictional' when 'R' then 'empirical' else 'x' end regime")
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    sources = s.join(n, s.s_nationkey == n.n_nationkey).selectExpr("s_suppkey doc_id", "case when s_nationkey % 2 = 0 then n_name else 'Base' end bundle")
    return ask.derive_facets(items, support, sources, "id")


@R.query("""WITH f AS (SELECT l_orderkey AS id, 'flag:' || string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS a,
  'status:' || string_agg(DISTINCT l_linestatus, '+' ORDER BY l_linestatus) AS b FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, coalesce(a || ' ' || b, '') AS facets FROM orders LEFT JOIN f ON id = o_orderkey UNION ALL SELECT -1, ''""")
def facets_of_items(spark, d):
    """The facets of the items asked for (of which one has none), as text."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    facets = li.select(F.col("l_orderkey").alias("id"), F.lit("flag").alias("axis"), F.col("l_returnflag").alias("value")).union(li.select("l_orderkey", F.lit("status"), "l_linestatus"))
    asked = o.select(F.col("o_orderkey").alias("id")).union(spark.sql("SELECT -1L"))
    out = ask.facets_of(asked, facets)
    each = F.transform(F.map_entries("facets"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "+")))
    return out.select("id", F.array_join(each, " ").alias("facets"))


@R.query("""WITH v AS (SELECT doc_id, list_transform(list_distinct(list_filter(regexp_split_to_array(lower('Doc ' || doc_id || CASE
  WHEN doc_id % 2 = 0 THEN '. ' || source ELSE '' END), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) > 2)), lambda t: ('0x' || substr(md5(t), 1,
  8))::BIGINT % 64) AS b FROM documents)
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'kept' WHEN doc_id % 5 = 0 THEN NULL ELSE 'made' END AS how, CASE
  WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN len(list_distinct(b)) END AS filled FROM v""")
def embedded_nodes(spark, d):
    """Every third node has a vector, every fifth is not active, and the others get one."""
    kept = F.array(F.lit(7.0))
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("label"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("summary"), F.when(F.col("doc_id") % 5 == 0, "merged").otherwise("active").alias("status"), F.when(F.col("doc_id") % 3 == 0, kept).alias("embedding"))
    out = library.embed_missing(nodes)
    old = F.coalesce(F.col("embedding") == kept, F.lit(False))
    return out.select("id", F.when(old, "kept").when(F.col("embedding").isNotNull(), "made").alias("how"), F.when(~old & F.col("embedding").isNotNull(), F.size(F.filter("embedding", lambda x: x != 0)).cast("long")).alias("filled"))


@R.query("SELECT turn AS seq, role AS section, text, greatest(1, length(text) // 4)::INT AS tokens, label FROM conversations LEFT JOIN embeddings ON vec_id = conv_id * 100 + turn WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def chunks_of_a_path(spark, d):
    c = table(spark, d, "conversations")
    chunks = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("path"), F.col("turn").alias("seq"), F.col("role").alias("section"), "text", T.est_tokens(F.col("text")).alias("tokens"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("vec"))
    return library.chunks_for_path(chunks, vectors, c.agg(F.min("conv_id")).first()[0]).withColumnRenamed("vec", "label")


# Sources are orders, their bundles the statuses; lines are edges between suppliers and parts.
_GRAPH = "s AS (SELECT o_orderkey AS doc_id, o_orderstatus AS bundle, o_orderpriority AS title FROM orders), e AS (SELECT DISTINCT l_suppkey * 1000000 + l_partkey AS edge_id, -l_suppkey AS src, l_partkey AS dst FROM lineitem), es AS (SELECT DISTINCT l_suppkey * 1000000 + l_partkey AS edge_id, l_orderkey AS doc_id FROM lineitem), ns AS (SELECT DISTINCT l_partkey AS node, l_orderkey AS doc_id FROM lineitem)"


def _graph(spark, d):
    li = table(spark, d, "lineitem")
    edge = F.col("l_suppkey") * 1000000 + F.col("l_partkey")
    sources = table(spark, d, "orders").selectExpr("o_orderkey doc_id", "o_orderstatus bundle", "o_orderpriority title", "'active' status")
    # Lines are dealt by the key that they are joined by, so that equal ones go where they are then joined.
    edges = li.select("l_suppkey", "l_partkey").repartition(edge).select(edge.alias("edge_id"), (-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    dealt = lambda what: li.select(what, F.col("l_orderkey").alias("doc_id")).repartition("doc_id").distinct()
    return sources, edges, dealt(edge.alias("edge_id")), dealt(F.col("l_partkey").alias("node"))


@R.query(f"""WITH {_GRAPH}, mine AS (SELECT DISTINCT bundle, node FROM ns JOIN s USING (doc_id)), own AS (SELECT DISTINCT bundle, src, dst FROM es
  JOIN s USING (doc_id) JOIN e USING (edge_id)), named AS (SELECT bundle, src AS node FROM own UNION SELECT bundle, dst FROM own),
r AS (SELECT bundle, node, false AS borrowed FROM mine UNION ALL SELECT bundle, node, true FROM named WHERE (bundle, node) NOT IN (SELECT (bundle, node) FROM mine))
SELECT bundle, borrowed, count(*) AS nodes, sum(node)::BIGINT AS ids FROM r GROUP BY 1, 2""")
def split_bundles(spark, d):
    return provenance.split_bundles(*_graph(spark, d)).groupBy("bundle", "borrowed").agg(F.count("*").alias("nodes"), F.sum("node").alias("ids"))


@R.query(f"""WITH {_GRAPH}, c AS (SELECT doc_id FROM s WHERE bundle IN ('O', 'P') AND title <> '5-LOW'), k AS (SELECT * FROM es WHERE doc_id IN (SELECT doc_id
  FROM c)), w AS (SELECT * FROM e WHERE edge_id IN (SELECT edge_id FROM k)), n AS (SELECT src AS node FROM w UNION SELECT dst FROM w UNION SELECT node
  FROM ns WHERE doc_id IN (SELECT doc_id FROM c))
SELECT 'sources' AS "table", count(*) AS rows FROM c UNION ALL SELECT 'edges', count(*) FROM w UNION ALL SELECT 'edge_support', count(*) FROM k
  UNION ALL SELECT 'nodes', count(*) FROM n""")
def assembled_tables(spark, d):
    return library.inspect_bundle(provenance.assemble(*_graph(spark, d), include=["O", "P"], exclude=["5-LOW"]))


@R.query(f"""WITH {_GRAPH}, f AS (SELECT doc_id FROM s WHERE bundle = 'F'), k AS (SELECT * FROM es WHERE doc_id NOT IN (SELECT doc_id FROM f)), w AS (SELECT *
  FROM e WHERE edge_id IN (SELECT edge_id FROM k)), n AS (SELECT src AS node FROM w UNION SELECT dst FROM w),
g AS (SELECT node FROM ns GROUP BY node HAVING bool_and(doc_id IN (SELECT doc_id FROM f)) AND node NOT IN (SELECT node FROM n))
SELECT 'sources' AS "table", count(*) AS rows FROM s WHERE doc_id NOT IN (SELECT doc_id FROM f) UNION ALL SELECT 'edges', count(*) FROM w UNION ALL
  SELECT 'edge_support', count(*) FROM k UNION ALL SELECT 'gone', count(*) FROM g""")
def ejected_bundle(spark, d):
    return library.inspect_bundle(provenance.eject(*_graph(spark, d), "F")[1])


# The intent that a speech act forces.
_FORCED = "CASE speech_act WHEN 'feasibility' THEN 'how' WHEN 'hypothetical' THEN 'what_if' WHEN 'counterfactual_omit' THEN 'what_if' WHEN 'observation' THEN 'what_if' WHEN 'in_progress' THEN 'how' WHEN 'diagnostic' THEN 'why_diag' WHEN 'comparison' THEN 'what' END"


@R.query(f"""WITH s AS ({text_queries.R.sql["speech_acts"]}), i AS ({text_queries.R.sql["intents"]})
SELECT conv_id * 100 + turn AS query_id, speech_act, confidence AS certainty, coalesce({_FORCED}, intent) AS intent, CASE
  WHEN regexp_matches(coalesce(text, ''), '{context.HIGH_STAKES}') THEN 'high' ELSE 'low' END AS rigor,
  confidence < 0.5 OR speech_act = 'ambiguous' AS broaden FROM s JOIN i USING (conv_id, turn) JOIN conversations USING (conv_id, turn)""")
def understood_questions(spark, d):
    """Speech act, intent, rigor and whether to broaden, of all turns."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return answers.understand(c).drop("query")


@R.query()
def answered_questions(spark, d):
    """Answers to questions about each supplier over a graph of suppliers, parts and what they cause; tests hold them against plain Python."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    return answers.answer(*answer_tables(s.join(n, s.s_nationkey == n.n_nationkey), table(spark, d, "part"), table(spark, d, "lineitem")), None, 6)


def answer_tables(s, p, li):
    """Questions, hits, nodes, edges, cards and support from suppliers (with nations), parts and lines."""
    node = lambda c: F.concat(F.lit("s"), c.cast("string"))
    forms = F.array(*[F.lit(x) for x in ("why does {} fail?", "how do we use {}?", "what causes {}?", "is it safe to use {}?", "what if we didn't use {}?", "{} or others?", "tell of {}", "what dose of {}?")])
    asked = s.select(node(F.col("s_suppkey")).alias("query_id"), F.replace(forms[(F.col("s_suppkey") % 8).cast("int")], F.lit("{}"), F.lower("s_name")).alias("query"))
    regime = lambda c: F.array(*[F.lit(x) for x in ("empirical", "fictional", "historical")])[(F.col(c) % 3).cast("int")]
    status = lambda c: F.when(F.col(c) % 11 == 0, "merged").otherwise("active")
    nodes = s.select(node(F.col("s_suppkey")).alias("id"), F.col("s_name").alias("label"), F.concat(F.lit("made in "), "n_name").alias("summary"), regime("s_suppkey").alias("regime"), status("s_suppkey").alias("status"))
    other = lambda c: node(F.col("l_suppkey") % 7 + 1) if c == "dst" else node(F.col("l_suppkey"))
    kinds = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("type"), F.lit(x).alias("polarity")) for f, t, x in (("causal", "causes", "positive"), ("causal", "prevents", ""), ("taxonomic", "is_a", ""), ("causal", "harms", "negative"), ("meta", "alternative_to", ""))])
    kind = kinds[(F.col("l_partkey") % 5).cast("int")]
    edges = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("id"), other("src").alias("src"), other("dst").alias("dst"), kind["family"].alias("family"), kind["type"].alias("type"), kind["polarity"].alias("polarity"), F.concat(F.lit("edge of part "), F.col("l_partkey").cast("string")).alias("brief"), regime("l_partkey").alias("regime"), F.lit("active").alias("status"), F.col("l_shipdate").alias("updated_at"))
    own = p.select(F.col("p_partkey").cast("string").alias("card_id"), node(F.col("p_partkey") % 50 + 1).alias("node_id"), F.col("p_name").alias("title"), F.concat(F.lit("use of "), "p_name").alias("goal"), regime("p_size").alias("regime"), F.lit("active").alias("status"))
    near = F.explode(F.array(*[F.struct((F.col("s_suppkey") + i).alias("k"), F.lit(0.9 - 0.1 * i).alias("score")) for i in range(3)])).alias("h")
    hits = s.select(node(F.col("s_suppkey")).alias("query_id"), near).select("query_id", F.lit("node").alias("kind"), node(F.col("h.k")).alias("id"), "h.score")
    support = s.select(F.lit("node").alias("kind"), node(F.col("s_suppkey")).alias("id"), F.col("n_name").alias("doc_id"), F.lit(0.7).alias("trust_weight"), F.lit("empirical").alias("regime"), F.lit("empirical").alias("origin"), F.when(F.col("s_suppkey") % 4 == 0, "research").alias("provenance"))
    return asked, hits, nodes, edges, own, support
