"""What a question brings along and how well an item fits it: stakes, plans, features, fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T

# Words (and their endings) of questions with high stakes.
HIGH_STAKES = r"(?i)\b(dose|dosage|dosing|drug|interaction|contraindicat|overdose|mg|medication|toxic|lethal|allerg|surger|diagnos|treat|symptom|legal|tax)"
# Closed features and their values; a value of two features belongs to the later one.
FEATURES = {
    "onset": ["sudden", "gradual", "delayed", "immediate"],
    "laterality": ["unilateral", "bilateral", "focal", "diffuse"],
    "timing": ["immediate", "delayed", "episodic", "constant", "intermittent"],
    "quality": ["burning", "sharp", "dull", "gritty", "itchy", "aching", "throbbing", "stabbing", "cramping", "tingling", "numb"],
    "severity": ["mild", "moderate", "severe"],
    "reversibility": ["transient", "persistent", "permanent"],
}
# Phrases that stand for a value.
PHRASES = {
    "both sides": "laterality:bilateral",
    "on both sides": "laterality:bilateral",
    "one side": "laterality:unilateral",
    "just one spot": "laterality:focal",
    "all over": "laterality:diffuse",
    "out of nowhere": "onset:sudden",
    "came on slowly": "onset:gradual",
    "comes and goes": "timing:episodic",
}
# The intent that a speech act forces; other acts leave it to the classifier.
PLANS = {
    "feasibility": "how",
    "hypothetical": "what_if",
    "counterfactual_omit": "what_if",
    "observation": "what_if",
    "in_progress": "how",
    "diagnostic": "why_diag",
    "comparison": "what",
}


def rigor(question: Column, extra: tuple[str, ...] = ()) -> Column:
    """high where a word of high stakes (or an extra pattern) occurs, else low; null reads as empty."""
    q = F.coalesce(question, F.lit(""))
    hit = q.rlike(HIGH_STAKES)
    for pattern in extra:
        hit = hit | q.rlike(f"(?i){pattern}")
    return F.when(hit, "high").otherwise("low")


def plan_intent(act: Column, classified: Column, override: Column | None = None) -> Column:
    """The intent to follow: an override, the speech act's own, or the classified one."""
    forced = F.create_map(*[F.lit(x) for pair in PLANS.items() for x in pair])[act]
    return F.coalesce(*([] if override is None else [override]), forced, classified)


def context_features(question: Column) -> Column:
    """The ``feature:value`` strings of a question, distinct and sorted: values with any ending, and phrases."""
    owner = {v: f for f, values in FEATURES.items() for v in values}
    q = F.lower(F.coalesce(question, F.lit("")))
    found = F.regexp_extract_all(q, F.lit(r"\b(" + "|".join(sorted(owner, key=len, reverse=True)) + ")"), 1)
    named = F.create_map(*[F.lit(x) for v, f in owner.items() for x in (v, f"{f}:{v}")])
    said = F.array(*[F.when(F.contains(q, F.lit(p)), F.lit(v)) for p, v in PHRASES.items()])
    return F.array_sort(F.array_distinct(F.concat(F.transform(found, lambda v: named[v]), F.array_compact(said))))


def answer_fit(overlap: Column, text_share: Column, excluded: Column, structured: Column) -> Column:
    """0 where a must-not-have feature is asked about; text alone without features on both sides; else both."""
    both = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * overlap + 0.3 * text_share))
    return F.when(excluded, 0.0).when(structured, both).otherwise(F.least(F.lit(1.0), text_share))


def text_share(question: Column, text: Column) -> Column:
    """The share of a question's ASCII terms of three letters or more that a text has."""
    q = T.ascii_terms(question, 2)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, T.ascii_terms(text, 2))) / (F.size(q) + 1e-6))


def reconcile(candidates: DataFrame, edges: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Adds action to candidate claims (edge_id, src, dst, family, regime).

    A claim known by its hash corroborates; an interpretive one, or one with nothing active to
    compare (equal ends and regime, outside ``meta``), is inserted; for the rest a table of
    decisions (edge_id, decision) made elsewhere is followed, and without one they wait.
    """
    live = edges.where("status = 'active' and family <> 'meta'")
    known = edges.select("edge_id", F.lit(True).alias("_known")).distinct()
    peers = live.groupBy("src", "dst", "regime").agg(F.count("*").alias("_peers"))
    rows = candidates.join(known, "edge_id", "left").join(peers, ["src", "dst", "regime"], "left")
    decided = F.lit(None).cast("string")
    if decisions is not None:
        rows, decided = rows.join(decisions.select("edge_id", F.col("decision").alias("_decision")), "edge_id", "left"), F.col("_decision")
    action = F.when(F.col("_known"), "corroborate").when((F.col("regime") == "interpretive") | F.col("_peers").isNull(), "insert").otherwise(F.coalesce(decided, F.lit("undecided")))
    return rows.withColumn("action", action).select(*candidates.columns, "action")


def alternatives(edges: DataFrame, limit: int = 8) -> DataFrame:
    """(node, other): the siblings of a node by active ``meta`` edges, the smallest ids up to the limit."""
    meta = edges.where("family = 'meta' and status = 'active' and type in ('alternative_to', 'context_variant_of') and src <> dst")
    both = meta.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(meta.select("dst", "src")).distinct()
    return both.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("other"))).where(F.col("n") <= limit).drop("n")


def edge_brief(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, brief): ``label —type→ label (polarity)`` of each edge; an id stands for a node without a label."""
    rows = edges
    for end in ("src", "dst"):
        rows = rows.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"_{end}")), end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", F.col(end).cast("string")))
    tail = F.when(F.coalesce("polarity", F.lit("")) != "", F.concat(F.lit(" ("), F.col("polarity"), F.lit(")"))).otherwise("")
    return rows.select("id", F.concat(F.col("_src"), F.lit(" —"), F.col("type"), F.lit("→ "), F.col("_dst"), tail).alias("brief"))


def contradictions(edges: DataFrame, support: DataFrame) -> DataFrame:
    """(edge, other, docs): claims that disagree with a claim, with the sorted documents behind them.

    The documents of one claim are a set that its row holds in the model itself.
    """
    meta = edges.where("family = 'meta' and type = 'disagrees_with'")
    both = meta.select(F.col("src").alias("edge"), F.col("dst").alias("other")).union(meta.select("dst", "src")).distinct()
    docs = support.join(both.select(F.col("other").alias("edge_id")).distinct(), "edge_id", "left_semi").groupBy(F.col("edge_id").alias("other")).agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    return both.join(docs, "other", "left").select("edge", "other", F.coalesce("docs", F.array().cast(docs.schema["docs"].dataType)).alias("docs"))


def content_version(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, version): a digest of a table's content, whatever the order of its rows.

    Each row's SHA-256 is cut in words that are summed, so that partial sums are all that is
    shuffled; any change of a row, or a row more or less, changes the version.
    """
    row = F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("\u0001")), F.lit("\u0000")) for c in columns])
    digest = frame.select(F.sha2(row, 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    return digest.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *words), 256).alias("version"))
