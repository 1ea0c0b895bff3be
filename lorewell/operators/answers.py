"""Answers to a batch of questions: what is known, walked by intent, filtered, ranked and framed.

Items are (query_id, kind, id, score, ...); the support of an item is rows (kind, id, doc_id,
trust_weight, regime, origin, provenance).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import ask, context
from lorewell.session import saved

# The regimes that a mode lets through; others let all.
MODES = {
    "science": ("empirical", "historical"),
    "scholarly": ("empirical", "historical", "interpretive", "conventional"),
    "humanities": ("interpretive", "conventional", "historical", "empirical"),
    "fiction": ("fictional", "interpretive", "conventional"),
}
# How a text is put by its regime, so that a story or an opinion is no fact.
FRAMES = {
    "conventional": "By convention: ",
    "fictional": "In the work: ",
    "interpretive": "An argued position: ",
    "historical": "As understood at the time: ",
}
# What is said of an answer of each band.
NOTES = {
    "high": "Well grounded — answer directly.",
    "medium": "Answer, but note any single-/older-source caveat.",
    "low": "Weak grounding — hedge.",
    "contra": "Sources disagree — present both with provenance and which is more trusted/recent.",
    "none": "No grounded answer in the knowledge base.",
}
# What a prior and a source of low trust count for, edges that warn, and edges that an omission would lose.
PRIOR, LOW_TRUST = 0.5, 0.85
WARNING = ("incompatible_with", "exacerbates", "worsens", "harms")
PREVENTING = ("prevents", "reduces", "protects_against", "controls")
# The walk of an intent: family, end of the edge that the concept is, and the role of what is found.
WALKS = {
    "why_mech": ("causal", "src", "effect"),
    "what_if": ("causal", "src", "effect"),
    "why_diag": ("causal", "dst", "cause"),
    "taxonomy": ("taxonomic", "src", "is_a"),
    "who": ("epistemic", "src", "attribution"),
    "where": ("spatial", "src", "location"),
}
#: Concepts that are walked from, edges and cards of each, and the fewest items of an answer.
WALKED, EDGES_EACH, CARDS_EACH, LEAST_ITEMS = 2, 20, 10, 8


def _said(table: dict[str, str], key: Column, other: str = "") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def framed(regime: Column, text: Column) -> Column:
    """A text as its regime asks; an empirical or unknown one as it is."""
    return F.concat(_said(FRAMES, F.coalesce(regime, F.lit("empirical"))), F.coalesce(text, F.lit("")))


def note(band: Column) -> Column:
    return _said(NOTES, band)


def trust_factors(support: DataFrame, bulk_docs: DataFrame | None, low: str = "research") -> DataFrame:
    """(kind, id, factor): PRIOR where all support is of bulk imports (doc_id), times LOW_TRUST where all is of a provenance of low trust."""
    bulk = None if bulk_docs is None else bulk_docs.select("doc_id", F.lit(True).alias("_bulk")).where("doc_id is not null").distinct()
    support = support.withColumn("_bulk", F.lit(False)) if bulk is None else support.join(bulk, "doc_id", "left")
    all_of = lambda c: F.min(F.coalesce(c, F.lit(False)).cast("int")) == 1
    rows = support.groupBy("kind", "id").agg(all_of(F.col("_bulk")).alias("p"), all_of(F.col("provenance") == low).alias("l"))
    return rows.select("kind", "id", (F.when(F.col("p"), PRIOR).otherwise(1.0) * F.when(F.col("l"), LOW_TRUST).otherwise(1.0)).alias("factor"))


def mode_filter(items: DataFrame, support: DataFrame, mode: str | None, strict: bool = False) -> DataFrame:
    """Items (kind, id, regime, ...) that a mode lets through: by the claim's regime, or, if strict, by any origin of its support.

    A strict item without an origin goes by its regime.
    """
    allowed = MODES.get(mode or "")
    if allowed is None:
        return items
    own = F.coalesce("regime", F.lit("empirical")).isin(list(allowed))
    if not strict:
        return items.where(own)
    origins = support.where("origin is not null").groupBy("kind", "id").agg(F.max(F.col("origin").isin(list(allowed)).cast("int")).alias("_any"))
    return items.join(origins, ["kind", "id"], "left").where(F.coalesce(F.col("_any") == 1, own)).drop("_any")


def understand(questions: DataFrame, override: Column | None = None) -> DataFrame:
    """Questions (query_id, query) with speech_act, certainty, intent, rigor and broaden."""
    act = T.speech_act(F.col("query"))
    rows = questions.withColumn("_act", act)
    plan = context.plan_intent(F.col("_act.act"), T.intent(F.col("query")), override)
    broaden = (F.col("_act.confidence") < 0.5) | (F.col("_act.act") == "ambiguous")
    return rows.withColumns({"speech_act": F.col("_act.act"), "certainty": F.col("_act.confidence"), "intent": plan, "rigor": context.rigor(F.col("query")), "broaden": broaden}).drop("_act")


def _walk(start: DataFrame, edges: DataFrame, end: str, families: list[str] | None) -> DataFrame:
    """(query_id, id, base, query, type, polarity, text, regime): the latest active edges of each concept; only real claims where rigor is high."""
    live = edges.where("status = 'active' and family <> 'meta'")
    live = live if families is None else live.where(F.col("family").isin(families))
    both = start.join(live.withColumnRenamed(end, "_node"), F.col("node") == F.col("_node")).where("rigor <> 'high' or regime = 'empirical'")
    latest = Window.partitionBy("query_id", "node").orderBy(F.desc("updated_at"), "id")
    return both.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= EDGES_EACH).select("query_id", "id", "base", "query", "type", "polarity", F.col("brief").alias("text"), "regime")


def answer(questions: DataFrame, hits: DataFrame, nodes: DataFrame, edges: DataFrame, cards: DataFrame, support: DataFrame, bulk_docs: DataFrame | None, k: int = 6, mode: str | None = None, strict: bool = False, card_hits: DataFrame | None = None, pressure: DataFrame | None = None, facets: DataFrame | None = None, required: dict[str, list] | None = None, excluded: dict[str, list] | None = None) -> DataFrame:
    """(query_id, rank, kind, id, role, score, text, confidence, band, tier, note): the items of each answer, and how well the best one grounds it.

    hits: (query_id, kind, id, score), what a search found.  nodes: (id, label, summary, regime,
    status); edges: (id, src, dst, family, type, polarity, brief, regime, status, updated_at);
    cards: (card_id, node_id, title, goal, regime, status); ids are strings.  The best concepts
    of a question are walked by its intent, its speech act pulls in more, and of an item found
    twice the first pool counts, in order: search, walk, pulls, words (``card_hits``).  Items
    rank by score and trust, under high rigor by the strength of their evidence first.
    """
    from lorewell.operators.cards import hydrate

    asked = saved(understand(questions))
    factors = saved(trust_factors(support, bulk_docs))
    shown = hydrate(hits.select("query_id", "kind", "id", "score"), nodes, edges, cards).join(asked.select("query_id", "rigor"), "query_id").where("rigor <> 'high' or regime = 'empirical' or kind <> 'edge'")
    found = saved(shown.join(factors, ["kind", "id"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0))))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.col("score") * F.col("factor")), "id")
    top = found.where("kind = 'node'").withColumn("place", F.row_number().over(best)).where(F.col("place") <= WALKED).select("query_id", F.col("id").alias("node"), F.col("score").alias("base"), "place")
    start = saved(top.join(asked, "query_id"))
    common = lambda rows, kind, role, score: rows.select("query_id", F.lit(kind).alias("kind"), "id", F.lit(role).alias("role"), score.alias("score"), "text", "regime")
    fit = context.answer_fit(F.lit(0.0), context.text_share(F.col("query"), F.col("text")), F.lit(False), F.lit(False))
    four = lambda c: F.floor(c * 10000 + 0.5) / 10000
    base = F.col("base")
    walked = []
    for intent, (family, end, role) in WALKS.items():
        rows = _walk(start.where(F.col("intent") == intent), edges, end, [family])
        walked.append(common(rows, "edge", role, four(base * (0.6 + 0.4 * fit) if intent == "why_diag" else base * 0.95)))
    live = cards.where("status = 'active'").withColumn("_n", F.row_number().over(Window.partitionBy("node_id").orderBy("card_id"))).where(F.col("_n") <= CARDS_EACH)
    own = start.where("intent = 'how'").join(live, F.col("node") == F.col("node_id")).select("query_id", F.col("card_id").alias("id"), "base", "query", F.col("goal").alias("text"), "regime")
    walked.append(common(own, "card", "management", four(base * (0.6 + 0.4 * fit))))
    first = start.where("place = 1")
    out = _walk(first.where("speech_act in ('feasibility', 'counterfactual_omit')").drop("speech_act"), edges, "src", ["causal"]).join(asked.select("query_id", "speech_act"), "query_id")
    warns = out.where((F.col("speech_act") == "feasibility") & ((F.col("polarity") == "negative") | F.col("type").isin(list(WARNING))))
    risks = out.where((F.col("speech_act") == "counterfactual_omit") & F.col("type").isin(list(PREVENTING)))
    others = first.where("speech_act = 'comparison'").join(context.alternatives(edges), "node").join(nodes.where("status = 'active'").select(F.col("id").alias("other"), F.col("summary").alias("text"), "regime"), "other").select("query_id", F.col("other").alias("id"), "base", "text", "regime")
    pulled = [common(warns, "edge", "caution", four(base * 0.9)), common(risks, "edge", "risk_if_omitted", four(base * 0.9)), common(others, "node", "alternative", four(base * 0.9))]
    pools = [found.select("query_id", "kind", "id", F.lit("concept").alias("role"), "score", "text", "regime"), *walked, *pulled]
    if card_hits is not None:
        words = hydrate(card_hits.select("query_id", F.lit("card").alias("kind"), "id", "score"), nodes, edges, cards)
        pools.append(words.select("query_id", "kind", "id", F.lit("concept").alias("role"), "score", "text", "regime"))
    rows = reduce(DataFrame.unionByName, [p.withColumn("pool", F.lit(i)) for i, p in enumerate(pools)])
    once = Window.partitionBy("query_id", "kind", "id").orderBy("pool", F.desc("score"), "role")
    items = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    items = mode_filter(items, support, mode, strict)
    if facets is not None and (required or excluded):
        key = F.concat_ws(":", "kind", "id")
        left = ask.facet_filter(items.select(key.alias("id")).distinct(), facets.select(key.alias("id"), "axis", "value"), required or {}, excluded)
        items = items.withColumn("_key", key).join(left.withColumnRenamed("id", "_key"), "_key", "left_semi").drop("_key")
    evidence = support.withColumn("key", F.concat_ws(":", "kind", "id")).withColumn("evidence_cluster", F.lit(None).cast("string") if "evidence_cluster" not in support.columns else F.col("evidence_cluster"))
    strong = ask.strength(evidence, "key", pressure)
    n = support.groupBy("kind", "id").agg(F.countDistinct("doc_id").alias("n_support"))
    ranked = items.join(factors, ["kind", "id"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0))).withColumn("key", F.concat_ws(":", "kind", "id")).join(strong, "key", "left").join(n, ["kind", "id"], "left").join(asked.select("query_id", "rigor"), "query_id")
    worth = F.when(F.col("rigor") == "high", F.coalesce("strength", F.lit(0.0)) * F.col("factor")).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.desc(worth), F.desc(F.col("score") * F.col("factor")), "kind", "id")
    kept = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, LEAST_ITEMS)).withColumn("rank", F.col("rank") - 1)
    disputed = edges.where("family = 'meta' and type = 'disagrees_with'")
    disputed = disputed.select(F.col("src").alias("id")).union(disputed.select("dst")).distinct().select(F.lit("edge").alias("kind"), "id", F.lit(True).alias("contradicted"))
    head = kept.where("rank = 0").join(disputed, ["kind", "id"], "left").withColumns({"contradicted": F.coalesce("contradicted", F.lit(False)), "n_support": F.coalesce("n_support", F.lit(0))})
    ground = ask.grounding(head).select("query_id", "confidence", "band", ask.tier(F.col("band")).alias("tier"), note(F.col("band")).alias("note"))
    given = kept.select("query_id", "rank", "kind", "id", "role", "score", framed(F.col("regime"), F.col("text")).alias("text")).join(ground, "query_id")
    nothing = asked.select("query_id").join(ground.select("query_id"), "query_id", "left_anti").select("query_id", F.lit(0.0).alias("confidence"), F.lit("none").alias("band"), F.lit(4).alias("tier"), F.lit(NOTES["none"]).alias("note"))
    return given.unionByName(nothing, allowMissingColumns=True)


def gap_questions(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, tier) of questions whose answer is associative at best: what to look into."""
    worst = answers.groupBy("query_id").agg(F.max("tier").alias("tier")).where("tier >= 3")
    return worst.join(questions, "query_id").select(F.lower(F.btrim("query")).alias("question"), "tier").distinct()
