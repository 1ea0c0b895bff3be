"""Procedure cards, items of all kinds, and changes of the graph by verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.operators import closure
from lorewell.operators.graph import claim_hash, key_hash

#: Characters of a card's text fields, at most.
TEXT_MOST = 500
TEXT_FIELDS, LIST_FIELDS = ("title", "goal", "domain"), ("steps",)


def _listed(steps: Column) -> Column:
    """A list of words as JSON with blanks after commas, which identities are made of."""
    each = F.transform(F.coalesce(steps, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))


def card_hash(node: Column, title: Column, goal: Column, steps: Column, card_type: Column, criteria: Column) -> Column:
    """A card's identity: concept, title, goal and steps, and for typed cards the type and the criteria (canonical JSON)."""
    kind = F.lower(F.btrim(F.coalesce(card_type, F.lit("procedure"))))
    plain = key_hash(F.lit("card"), node, title, goal, _listed(steps))
    typed = key_hash(F.lit("card"), node, title, goal, _listed(steps), kind, F.coalesce(criteria, F.lit("{}")))
    return F.when((kind == "procedure") & (F.coalesce(criteria, F.lit("")) == ""), plain).otherwise(typed)


def _own_hash() -> Column:
    return card_hash(*[F.col(c) for c in ("node_id", "title", "goal", "steps", "card_type", "criteria")])


def add_cards(cards: DataFrame, support: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cards, support, actions) after drafts (node_id, title, goal, steps, card_type, criteria, doc_id, trust_weight).

    A draft of a known identity corroborates: its document joins the card's support, once.  Of
    several new drafts of one identity, the first by document is inserted.
    """
    drafts = new.withColumn("card_hash", _own_hash())
    known = cards.select("card_hash", "card_id")
    fields = ["node_id", "title", "goal", "steps", "card_type", "criteria"]
    one = drafts.groupBy("card_hash").agg(F.min_by(F.struct(*fields), "doc_id").alias("f"), F.count("*").alias("n"))
    fresh = one.join(known.select("card_hash"), "card_hash", "left_anti").select(F.col("card_hash").alias("card_id"), "card_hash", *[F.col(f"f.{c}").alias(c) for c in fields], F.lit("active").alias("status"))
    ids = drafts.join(known, "card_hash", "left").select(F.coalesce("card_id", "card_hash").alias("card_id"), F.col("card_id").isNotNull().alias("known"), "doc_id", "trust_weight")
    entries = ids.where("doc_id is not null").groupBy("card_id", "doc_id").agg(F.max("trust_weight").alias("trust_weight"))
    merged = entries.unionByName(support.join(entries.select("card_id", "doc_id"), ["card_id", "doc_id"], "left_anti").select("card_id", "doc_id", "trust_weight"))
    actions = ids.groupBy("card_id").agg(F.when(F.bool_or("known"), "corroborate").otherwise("insert").alias("action"), F.count("*").alias("drafts"))
    return cards.unionByName(fresh, allowMissingColumns=True), merged, actions


def refresh_cards(cards: DataFrame, edits: DataFrame) -> DataFrame:
    """Cards with the fields that edits (card_id, ...) set, and the identity that follows; the support is another table and stays."""
    fields = [c for c in edits.columns if c in (*TEXT_FIELDS, *LIST_FIELDS) and c in cards.columns]
    cut = lambda c: F.substring(F.col(c), 1, TEXT_MOST) if c in TEXT_FIELDS else F.col(c)
    rows = cards.join(edits.select("card_id", *[cut(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_edited")), "card_id", "left")
    for c in fields:
        rows = rows.withColumn(c, F.coalesce(f"_{c}", c))
    return rows.withColumn("card_hash", F.when(F.col("_edited"), _own_hash()).otherwise(F.col("card_hash"))).select(cards.columns)


def cards_for(nodes: DataFrame, cards: DataFrame, limit: int = 10) -> DataFrame:
    """(node_id, card_id): the active cards of each node, the smallest ids up to the limit."""
    own = cards.where("status = 'active'").join(nodes.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "card_id")
    return own.withColumn("n", F.row_number().over(Window.partitionBy("node_id").orderBy("card_id"))).where(F.col("n") <= limit).drop("n")


def hydrate(items: DataFrame, nodes: DataFrame, edges: DataFrame, cards: DataFrame) -> DataFrame:
    """Items (kind, id, ...) with label, text, regime and node_id of the active row of their kind; others are left out.

    nodes: (id, label, summary, regime, status); edges: (id, brief, regime, status); cards:
    (card_id, title, goal, regime, node_id, status).
    """
    none = F.lit(None).cast("string")
    rows = [
        nodes.where("status = 'active'").select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("id"), "label", F.col("summary").alias("text"), "regime", none.alias("node_id")),
        edges.where("status = 'active'").select(F.lit("edge").alias("kind"), F.col("id").cast("string").alias("id"), none.alias("label"), F.col("brief").alias("text"), "regime", none.alias("node_id")),
        cards.where("status = 'active'").select(F.lit("card").alias("kind"), F.col("card_id").cast("string").alias("id"), F.col("title").alias("label"), F.col("goal").alias("text"), "regime", F.col("node_id").cast("string").alias("node_id")),
    ]
    own = items.withColumn("id", F.col("id").cast("string"))
    return reduce(DataFrame.unionByName, [own.join(r, ["kind", "id"]) for r in rows])


def enrich_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the modifiers (a map) of (edge_id, modifiers), a row an edge, over their own, where these are not empty."""
    both = edges.join(new.select("edge_id", F.col("modifiers").alias("_new")), "edge_id", "left")
    empty = F.create_map().cast("map<string,string>")
    full = F.map_filter(F.coalesce("_new", empty), lambda _, v: F.coalesce(v, F.lit("")) != "")
    rest = F.map_filter(F.coalesce("modifiers", empty), lambda k, _: ~F.map_contains_key(full, k))
    return both.withColumn("modifiers", F.map_concat(rest, full)).select(edges.columns)


def link_meta(pairs: DataFrame) -> DataFrame:
    """Claims between claims (a, b, type) as edges of the meta family, one of each."""
    rows = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("meta").alias("family"), "type", F.lit("").alias("polarity"), F.lit("meta").alias("regime"), F.lit("active").alias("status")).distinct()
    return rows.withColumn("edge_id", claim_hash())


def open_candidates(queue: DataFrame, nodes: DataFrame) -> DataFrame:
    """The queue (a, b, similarity, status) with open pairs of a node that is no longer active marked stale."""
    live = nodes.where("status = 'active'").select("id")
    marked = queue.join(live.select(F.col("id").alias("a"), F.lit(True).alias("_a")), "a", "left").join(live.select(F.col("id").alias("b"), F.lit(True).alias("_b")), "b", "left")
    stale = (F.col("status") == "open") & (F.col("_a").isNull() | F.col("_b").isNull())
    return marked.withColumn("status", F.when(stale, "stale").otherwise(F.col("status"))).select(queue.columns)


def apply_verdicts(queue: DataFrame, verdicts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, outcome, survivor, loser, src, dst) of open pairs with a verdict (a, b, decision).

    same merges into the node of more support (b if equal), is_a in either direction links the
    special to the general, and all else is distinct; a pair of a node that is gone is stale.
    """
    live = nodes.where("status = 'active'").select("id", "n_support")
    side = lambda c: live.select(F.col("id").alias(c), F.col("n_support").alias(f"_{c}"))
    rows = queue.where("status = 'open'").select("a", "b").join(verdicts.select("a", "b", "decision"), ["a", "b"]).join(side("a"), "a", "left").join(side("b"), "b", "left")
    gone = F.col("_a").isNull() | F.col("_b").isNull()
    turned, linked = F.col("decision") == "b_is_a_a", F.col("decision").isin("a_is_a_b", "b_is_a_a")
    outcome = F.when(gone, "stale").when(F.col("decision") == "same", "merged").when(linked, "is_a").otherwise("distinct")
    first = F.col("_a") > F.col("_b")
    pick = lambda kind, cond, x, y: F.when(F.col("outcome") == kind, F.when(cond, F.col(x)).otherwise(F.col(y)))
    return rows.withColumn("outcome", outcome).select("a", "b", "outcome", pick("merged", first, "a", "b").alias("survivor"), pick("merged", first, "b", "a").alias("loser"), pick("is_a", turned, "b", "a").alias("src"), pick("is_a", turned, "a", "b").alias("dst"))


def repoint(table: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """Rows whose column names a loser of (loser, survivor) name the survivor instead."""
    to = merged.select(F.col("loser").alias(column), F.col("survivor").alias("_to"))
    return table.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).select(table.columns)


def merge_node_rows(nodes: DataFrame, node_support: DataFrame, aliases: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, support, aliases) after merges: losers are marked, their support and names join those of the node that their merges end at, each once.

    nodes: (id, label, status); node_support: (id, doc_id, ...); aliases: (id, alias).
    """
    merged = closure.settle(merged)
    lost = merged.select(F.col("loser").alias("id"), F.lit(True).alias("_lost"))
    marked = nodes.join(lost, "id", "left").withColumn("status", F.when(F.col("_lost"), "merged").otherwise(F.col("status"))).select(nodes.columns)
    support = repoint(node_support, merged, "id").dropDuplicates(["id", "doc_id"])
    names = aliases.unionByName(nodes.join(lost, "id", "left_semi").select("id", F.col("label").alias("alias")))
    own = marked.select("id", F.col("label").alias("alias"))
    return marked, support, repoint(names, merged, "id").distinct().join(own, ["id", "alias"], "left_anti")


def close_gaps(gaps: DataFrame, answered: DataFrame) -> DataFrame:
    """Gaps (question, status, ...) closed where an answered question is the same, trimmed and lower-cased."""
    form = lambda c: F.lower(F.btrim(c))
    done = answered.select(form("question").alias("_form"), F.lit(True).alias("_done")).distinct()
    rows = gaps.join(done, form("question") == F.col("_form"), "left")
    return rows.withColumn("status", F.when(F.col("_done") & (F.col("status") == "open"), "closed").otherwise(F.col("status"))).select(gaps.columns)
