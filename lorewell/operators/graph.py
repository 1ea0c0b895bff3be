"""The concept graph: support sets, claims, neighbours, entity resolution and merges.

Nodes (id, label, kind, status, support), edges (id, src, dst, family, type, polarity, regime,
status, support, updated_at).  A support entry is (doc_id, evidence_cluster, trust_weight,
regime); a set of them is keyed by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import closure
from lorewell.operators.blocks import ANY, near_in_blocks

SAME_SIM, NEAR_SIM, STRONG_SIM = 0.86, 0.72, 0.93
CLAIM = ("src", "dst", "family", "type", "polarity", "regime")


def key_hash(*parts: Column) -> Column:
    """20 hex digits over parts that each end with a NUL."""
    return F.substring(F.sha1(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\u0000")) for p in parts])), 1, 20)


def claim_hash(frame_cols: tuple[str, ...] = CLAIM) -> Column:
    return key_hash(*[F.col(c) for c in frame_cols])


def merge_support(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, doc_id, seq, ...) to one a key and document: later entries overlay earlier fields that they set."""
    fields = [c for c in entries.columns if c not in (*keys, "doc_id", "seq")]
    overlay = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
    return entries.groupBy(*keys, "doc_id").agg(F.min("seq").alias("seq"), *overlay)


def corroborate(claims: DataFrame) -> DataFrame:
    """Claims (CLAIM, doc_id, trust_weight) to edges: one a claim, with the number of documents and the largest trust."""
    hashed = claims.withColumn("edge_id", claim_hash())
    return hashed.groupBy("edge_id", *CLAIM).agg(F.countDistinct("doc_id").alias("n_support"), F.max("trust_weight").alias("trust"))


def comparable_edges(edges: DataFrame) -> DataFrame:
    """Pairs of active claims with equal ends and regime, through the smallest id of each group."""
    first = edges.where("status = 'active' and family <> 'meta'").groupBy("src", "dst", "regime").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return edges.where("status = 'active' and family <> 'meta'").join(first, ["src", "dst", "regime"]).where("id <> first").select("first", "id")


def neighbours(edges: DataFrame, limit: int = 8, cards: DataFrame | None = None) -> DataFrame:
    """(node, other, updated_at): the latest distinct neighbours of each node in both directions.

    With cards (node_id, status), has_card too: whether the neighbour has an active one.
    """
    live = edges.where("status = 'active' and family <> 'meta'")
    both = live.select(F.col("src").alias("node"), F.col("dst").alias("other"), "updated_at").unionAll(live.select("dst", "src", "updated_at"))
    latest = both.groupBy("node", "other").agg(F.max("updated_at").alias("updated_at"))
    w = Window.partitionBy("node").orderBy(F.desc("updated_at"), "other")
    near = latest.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")
    if cards is None:
        return near
    holders = cards.where("status = 'active'").select(F.col("node_id").alias("other"), F.lit(True).alias("has_card")).distinct()
    return near.join(holders, "other", "left").select("node", "other", "updated_at", F.coalesce("has_card", F.lit(False)).alias("has_card"))


def edges_from(edges: DataFrame, limit: int = 20, families: list[str] | None = None) -> DataFrame:
    """The latest active claims of each source node."""
    live = edges.where("status = 'active' and family <> 'meta'")
    live = live if families is None else live.where(F.col("family").isin(families))
    w = Window.partitionBy("src").orderBy(F.desc("updated_at"), "id")
    return live.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")


def contradiction_pressure(disagreements: DataFrame, support: DataFrame) -> DataFrame:
    """(edge, pressure): the sum over contradicting claims of 1 - exp(-trust / 2), for pairs (a, b)."""
    both = disagreements.select(F.col("a").alias("edge"), F.col("b").alias("against")).unionAll(disagreements.select("b", "a")).distinct()
    mass = support.groupBy(F.col("edge_id").alias("against")).agg(F.sum("trust_weight").alias("t"))
    return both.join(mass, "against").groupBy("edge").agg(F.round(F.sum(1 - F.exp(-F.col("t") / 2)), 9).alias("pressure"))


def modal_regime(support: DataFrame, key: str) -> DataFrame:
    """(key, regime): the most frequent regime of the support, the first in order of equal ones."""
    counted = support.where("regime is not null").groupBy(key, "regime").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "regime")
    return counted.withColumn("k", F.row_number().over(w)).where("k = 1").select(key, "regime")


def stems(label: Column) -> Column:
    return F.array_distinct(F.transform(T.ascii_terms(label), T.stem))


def lexical_decision(a: Column, b: Column, sim: Column, strong: float = STRONG_SIM) -> Column:
    """same, a_is_a_b, b_is_a_a or null, from the stems of two labels (arrays) and their similarity."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), None)
        .when((both == F.size(a)) & (both == F.size(b)), "same")
        .when(both == F.size(a), "b_is_a_a")
        .when(both == F.size(b), "a_is_a_b")
        .when((sim >= strong) & (both / union >= 0.5), "same")
    )


def resolve_queue(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, decision, survivor) of a merge queue (a, b, similarity): the node of more support survives, a if equal."""
    live = nodes.where("status = 'active'").select("id", stems(F.col("label")).alias("s"), "n_support")
    left = live.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("n_support").alias("na"))
    right = live.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("n_support").alias("nb"))
    rows = candidates.join(left, "a", "left").join(right, "b", "left")
    lexical = lexical_decision(F.col("sa"), F.col("sb"), F.col("similarity"))
    decision = F.when(F.col("sa").isNull() | F.col("sb").isNull(), "stale").when(lexical.isNotNull(), lexical).when(F.col("similarity") >= 0.90, "escalate").otherwise("deferred")
    return rows.withColumn("decision", decision).select("a", "b", "decision", F.when(F.col("decision") == "same", F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b"))).alias("survivor"))


def merge_nodes(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges (src, dst, family, type, polarity, regime, doc_id, trust_weight) re-pointed to where (loser, survivor) end, without self-loops, equal claims as one."""
    merged = closure.settle(merged)

    def moved(frame: DataFrame, end: str) -> DataFrame:
        to = merged.select(F.col("loser").alias(end), F.col("survivor").alias("_to"))
        return frame.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")

    return corroborate(moved(moved(edges, "src"), "dst").where("src <> dst"))


def knn_pairs(vectors: DataFrame, anchors: DataFrame, k: int = 3, floor: float = 0.5, known: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity): each anchor's k nearest other vectors above a floor, without pairs known already.

    Vectors and anchors (whole numbers as ids) meet in bounded blocks; a block keeps k rows of an anchor and
    as many more as it has known pairs of its own.
    """
    asked = anchors.select("id", "vec").withColumn("more", F.lit(0))
    pair = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
    if known is not None:
        known = known.select(*pair).distinct()
        own = known.select(F.col("x").alias("id")).unionAll(known.select("y")).groupBy("id").agg(F.count("*").alias("own"))
        asked = asked.join(own, "id", "left").select("id", "vec", F.coalesce("own", F.lit(0)).alias("more"))
    rows = near_in_blocks(asked.select("id", "vec", (F.col("more") + k).alias("keep"), F.lit(floor).alias("floor"), F.lit(ANY).alias("tie")), vectors)
    near = rows.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").alias("similarity"))
    if known is not None:
        near = near.select("*", *pair).join(known, ["x", "y"], "left_anti").drop("x", "y")
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def gap_log(queries: DataFrame) -> DataFrame:
    """(question, misses, last) of missed queries (question, at), by their trimmed lower-cased form."""
    return queries.groupBy(F.lower(F.btrim("question")).alias("question")).agg(F.count("*").alias("misses"), F.max("at").alias("last"))


def annotate(requested: DataFrame, nodes: DataFrame, cards: DataFrame, region: str) -> DataFrame:
    """(id, annotated, cards) for exactly the distinct ids requested; cards of nodes outside the region are left out."""
    inside = nodes.where(F.col("label").startswith(region))
    own = cards.join(inside.select(F.col("id").alias("node_id")), "node_id").groupBy("node_id").agg(F.array_sort(F.collect_list("card_id")).alias("cards"))
    known = nodes.select("id", F.lit(True).alias("known"))
    rows = requested.select("id").distinct().join(known, "id", "left").join(own.withColumnRenamed("node_id", "id"), "id", "left")
    return rows.select("id", F.coalesce("known", F.lit(False)).alias("annotated"), F.coalesce("cards", F.array().cast(own.schema["cards"].dataType)).alias("cards"))
