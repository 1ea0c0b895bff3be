"""Public knowledge datasets to claims (src, type, dst, ...), with counts of what is skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T

# What each relation becomes: family, type and polarity.
RELATIONS = {
    "IsA": ("taxonomic", "is_a", ""),
    "InstanceOf": ("taxonomic", "instance_of", ""),
    "MannerOf": ("taxonomic", "manner_of", ""),
    "DefinedAs": ("taxonomic", "defined_as", ""),
    "PartOf": ("partonomic", "part_of", ""),
    "HasA": ("partonomic", "has_a", ""),
    "MadeOf": ("partonomic", "made_of", ""),
    "UsedFor": ("functional", "used_for", ""),
    "CapableOf": ("functional", "capable_of", ""),
    "NotCapableOf": ("functional", "capable_of", "negative"),
    "ReceivesAction": ("functional", "receives_action", ""),
    "Causes": ("causal", "causes", "positive"),
    "CausesDesire": ("causal", "causes_desire", "positive"),
    "MotivatedByGoal": ("causal", "motivated_by_goal", ""),
    "CreatedBy": ("causal", "created_by", ""),
    "Entails": ("causal", "entails", ""),
    "HasPrerequisite": ("causal", "has_prerequisite", ""),
    "HasSubevent": ("procedural", "has_subevent", ""),
    "HasFirstSubevent": ("procedural", "has_first_subevent", ""),
    "HasLastSubevent": ("procedural", "has_last_subevent", ""),
    "AtLocation": ("spatial", "at_location", ""),
    "LocatedNear": ("spatial", "located_near", ""),
    "HasProperty": ("attributive", "has_property", "positive"),
    "NotHasProperty": ("attributive", "has_property", "negative"),
    "Desires": ("affective", "desires", "positive"),
    "NotDesires": ("affective", "desires", "negative"),
    "SymbolOf": ("interpretive", "symbol_of", ""),
    "Synonym": ("lexical", "synonym", ""),
    "Antonym": ("lexical", "antonym", "negative"),
    "DistinctFrom": ("lexical", "distinct_from", ""),
    "SimilarTo": ("lexical", "similar_to", ""),
    "RelatedTo": ("associative", "related_to", ""),
    "FormOf": ("lexical", "form_of", ""),
    "DerivedFrom": ("lexical", "derived_from", ""),
    "HasContext": ("lexical", "has_context", ""),
    "EtymologicallyRelatedTo": ("lexical", "etymologically_related_to", ""),
    "EtymologicallyDerivedFrom": ("lexical", "etymologically_derived_from", ""),
}
# Relations about words rather than things, left out unless asked for.
LEXICAL = ["RelatedTo", "FormOf", "DerivedFrom", "HasContext", "EtymologicallyRelatedTo", "EtymologicallyDerivedFrom"]
#: The nine dimensions of the event dataset.
DIMENSIONS = ["oEffect", "oReact", "oWant", "xAttr", "xEffect", "xIntent", "xNeed", "xReact", "xWant"]


def read_tsv(spark, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="").toDF("uri", "rel", "start", "end", "info")


def read_csv(spark, path: str) -> DataFrame:
    """A table with a header, long quoted cells and JSON in cells (quotes doubled)."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def read_records(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, (lines, bad)) of JSON lines of causal relations: records that parse, and how many lines do not."""
    payload = "struct<sentence: string, wikipedia_page_title: string, clueweb12_page_id: string>"
    concept = "struct<concept: string>"
    schema = f"causal_relation struct<cause: {concept}, effect: {concept}>, sources array<struct<type: string, payload: {payload}>>, _bad string"
    lines = spark.read.text(path).where(F.btrim("value") != "")
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.where("_bad is null and causal_relation is not null").drop("_bad"), rows.agg(F.count("*").alias("lines"), F.count_if(F.col("_bad").isNotNull() | F.col("causal_relation").isNull()).alias("bad"))


def assertions(rows: DataFrame, min_weight: float = 1.0, exclude: list[str] | None = None, lexical: bool = False) -> DataFrame:
    """(uri, rel, src, dst, family, type, polarity, weight, outcome) of rows (uri, rel, start, end, info) of English terms.

    outcome is kept, or why a row is skipped, in order: language, unknown, excluded, lexical,
    weight, loop (or a term is empty), repeat.  ``exclude`` names relations, and holds whatever
    ``lexical`` says.
    """
    english = F.col("start").startswith("/c/en/") & F.col("end").startswith("/c/en/")
    weight = F.coalesce(F.expr("try_cast(get_json_object(info, '$.weight') as double)"), F.lit(1.0))
    name = F.get(F.split("rel", "/"), F.lit(2))
    spec = F.try_element_at(F.create_map(*[x for k, v in RELATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), name)
    base = rows.select("*", name.alias("name"), spec.alias("spec"), F.btrim(T.concept(F.col("start"))).alias("src"), F.btrim(T.concept(F.col("end"))).alias("dst"), weight.alias("weight"))
    why = F.when(~english, "language").when(F.col("spec").isNull(), "unknown").when(F.col("name").isin([x.removeprefix("/r/") for x in exclude or []]), "excluded")
    if not lexical:
        why = why.when(F.col("name").isin(LEXICAL), "lexical")
    empty = (F.col("src") == "") | (F.col("dst") == "")
    why = why.when(F.col("weight") < min_weight, "weight").when(empty | (F.col("src") == F.col("dst")), "loop").otherwise("kept")
    judged = base.withColumn("why", why)
    first = Window.partitionBy("rel", "src", "dst", "why").orderBy("uri")
    outcome = F.when((F.col("why") == "kept") & (F.row_number().over(first) > 1), "repeat").otherwise(F.col("why"))
    parts = [F.get("spec", F.lit(i)).alias(c) for i, c in enumerate(("family", "type", "polarity"))]
    return judged.withColumn("outcome", outcome).select("uri", "rel", "src", "dst", *parts, "weight", "outcome")


def events(rows: DataFrame, agreement: int = 2) -> DataFrame:
    """(event, dim, value, n) of rows (event and DIMENSIONS as JSON arrays): values that so many annotators gave, first spelling kept."""
    cols = [c for c in DIMENSIONS if c in rows.columns]
    long = rows.unpivot("event", cols, "dim", "raw")
    each = long.select("event", "dim", F.posexplode(F.from_json("raw", "array<string>")).alias("pos", "v"))
    named = each.select("event", "dim", "pos", F.btrim("v").alias("v"), F.lower(F.btrim("v")).alias("k")).where("k <> 'none' and k <> ''")
    return named.groupBy("event", "dim", "k").agg(F.count("*").alias("n"), F.min_by("v", "pos").alias("value")).where(F.col("n") >= agreement).select("event", "dim", "value", "n")


def causal_rules(rows: DataFrame, dims: int = 10, least: int = 1) -> DataFrame:
    """(cause, connective, effect, n, dim) of rows with columns ``1_generalNL`` to ``10_generalNL``: "a >Connective> b"."""
    cols = [f"{i}_generalNL" for i in range(1, dims + 1) if f"{i}_generalNL" in rows.columns]
    long = rows.unpivot([], cols, "dim", "rule").where("rule is not null and lower(trim(rule)) <> 'escaped'")
    p = r"^\s*(.*?)\s*>([A-Za-z/ ]+)>\s*(.*?)\s*$"
    part = lambda i: F.regexp_extract("rule", p, i)
    parsed = long.select(F.regexp_extract("dim", "^([0-9]+)", 1).cast("int").alias("dim"), part(1).alias("cause"), part(2).alias("connective"), part(3).alias("effect")).where("cause <> '' and effect <> ''")
    return parsed.groupBy("cause", "connective", "effect").agg(F.count("*").alias("n"), F.min("dim").alias("dim")).where(F.col("n") >= least)


def causes(rows: DataFrame, min_sources: int = 1) -> DataFrame:
    """(cause, effect, n_sources, sentence) of records with causal_relation and sources.

    Sources count once by type and page, id or sentence; the sentence kept is a Wikipedia one if there is any.
    """
    name = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    each = rows.select(name("causal_relation.cause.concept").alias("cause"), name("causal_relation.effect.concept").alias("effect"), F.explode("sources").alias("s"))
    p = lambda k: F.col(f"s.payload.{k}")
    key = F.concat_ws("|", "s.type", F.coalesce(p("wikipedia_page_title"), p("clueweb12_page_id"), p("sentence")))
    rank = F.struct(F.when(F.col("s.type").startswith("wikipedia"), 0).otherwise(1).alias("r"), p("sentence").alias("t"))
    out = each.groupBy("cause", "effect").agg(F.countDistinct(key).alias("n_sources"), F.min(rank).alias("best"))
    return out.where(F.col("n_sources") >= min_sources).select("cause", "effect", "n_sources", F.col("best.t").alias("sentence"))


def gold_lines(lines: DataFrame) -> DataFrame:
    """(id, query, category, judgments) of JSON lines (value), without blank lines and comments."""
    real = lines.where((F.btrim("value") != "") & ~F.btrim("value").startswith("#"))
    row = F.from_json("value", "id string, query string, category string, judgments map<string,int>").alias("r")
    return real.select(row).select("r.id", "r.query", F.coalesce("r.category", F.lit("lookup_fact")).alias("category"), F.coalesce("r.judgments", F.create_map().cast("map<string,int>")).alias("judgments"))

