"""Corpus statistics of postings (card_id, concept_id, local_count): salience and co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.operators.context import content_version

#: Concepts of a salient set, and the fewest cards of a pair.
K_COOC, MIN_COOC = 20, 3


def _round6(x):
    return F.floor(x * 1e6 + 0.5) / 1e6


def malformed(postings: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """(card_id, concept_id, error): repeated pairs, counts below one, unknown concepts."""
    twice = postings.groupBy("card_id", "concept_id").count().where("count > 1").select("card_id", "concept_id", F.lit("duplicate").alias("error"))
    low = postings.where("local_count is null or local_count < 1").select("card_id", "concept_id", F.lit("count").alias("error"))
    out = twice.unionAll(low)
    if concepts is not None:
        out = out.unionAll(postings.join(concepts.select("concept_id"), "concept_id", "left_anti").select("card_id", "concept_id", F.lit("unknown").alias("error")))
    return out


def _raw(postings: DataFrame) -> DataFrame:
    n = postings.agg(F.countDistinct("card_id").alias("n_cards"))
    idf = postings.groupBy("concept_id").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    idf = idf.select("concept_id", "df", "n_cards", (F.log((F.col("n_cards") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    rows = postings.join(idf, "concept_id")
    return rows.withColumn("raw", F.round((1 + F.log(F.col("local_count").cast("double"))) * F.col("idf"), 12))


def salience(postings: DataFrame) -> DataFrame:
    """(card_id, concept_id, weight): damped count times smoothed idf, over the card's largest."""
    most = F.max("raw").over(Window.partitionBy("card_id"))
    return _raw(postings).select("card_id", "concept_id", _round6(F.col("raw") / most).alias("weight"))


def cooccurrence(postings: DataFrame, k_cooc: int = K_COOC, min_cooc: int = MIN_COOC) -> DataFrame:
    """(concept_a, concept_b, cooc_count, pmi, outcome): pairs within the cards' salient sets.

    outcome is kept, floor (seen fewer than ``min_cooc`` times) or clamp (no more than chance).
    A salient set has k_cooc concepts at most, so that pairs grow with the cards alone.
    """
    w = Window.partitionBy("card_id").orderBy(F.desc("raw"), "concept_id")
    salient = _raw(postings).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k_cooc).select("card_id", "concept_id", "n_cards")
    sets = salient.groupBy("card_id", "n_cards").agg(F.sort_array(F.collect_list("concept_id")).alias("s"))
    sdf = salient.groupBy("concept_id").agg(F.count("*").alias("sdf"))
    one = sets.select("n_cards", "s", F.posexplode("s").alias("i", "concept_a"))
    pairs = one.select("n_cards", "concept_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("concept_b"))
    counted = pairs.groupBy("concept_a", "concept_b", "n_cards").agg(F.count("*").alias("cooc_count"))
    both = counted.join(sdf.select(F.col("concept_id").alias("concept_a"), F.col("sdf").alias("a")), "concept_a").join(sdf.select(F.col("concept_id").alias("concept_b"), F.col("sdf").alias("b")), "concept_b")
    pmi = F.log(F.col("cooc_count") * F.col("n_cards") / (F.col("a") * F.col("b")))
    out = both.withColumn("pmi", F.when(F.col("cooc_count") >= min_cooc, _round6(pmi)))
    outcome = F.when(F.col("cooc_count") < min_cooc, "floor").when(pmi <= 0, "clamp").otherwise("kept")
    return out.select("concept_a", "concept_b", "cooc_count", "pmi", outcome.alias("outcome"))


#: The algorithm that a version names, and what parts a version's text.
ALGORITHM, PARTS = "salience-cooccurrence/1.0", "\x1e"


def check_params(k_cooc: int, min_cooc: int) -> None:
    """Raises ValueError for a salient set of under two concepts or a floor below one."""
    for name, value, least in (("k_cooc", k_cooc, 2), ("min_cooc", min_cooc, 1)):
        if isinstance(value, bool) or not isinstance(value, int) or value < least:
            raise ValueError(f"E_BAD_PARAM: {name} is a whole number of {least} or more, not {value!r}")


def stats_version(postings: DataFrame, k_cooc: int = K_COOC, min_cooc: int = MIN_COOC, algorithm: str = ALGORITHM) -> DataFrame:
    """(postings, version): SHA-256 over algorithm, parameters and a digest of the postings, whatever their order."""
    check_params(k_cooc, min_cooc)
    params = f'{{"K_COOC":{k_cooc},"MIN_COOC":{min_cooc}}}'
    content = content_version(postings, ["card_id", "concept_id", "local_count"])
    return content.select(F.col("rows").alias("postings"), F.sha2(F.concat_ws(PARTS, F.lit(algorithm), F.lit(params), F.col("version")), 256).alias("version"))


def report(postings: DataFrame, k_cooc: int = K_COOC, min_cooc: int = MIN_COOC, algorithm: str = ALGORITHM) -> DataFrame:
    """(section, a, b, line): JSON lines of the head (version, parameters, cards), the salience and the kept pairs, in the order of these columns."""
    n = postings.agg(F.countDistinct("card_id").alias("n"))
    params = F.struct(F.lit(k_cooc).alias("K_COOC"), F.lit(min_cooc).alias("MIN_COOC"))
    head = stats_version(postings, k_cooc, min_cooc, algorithm).join(n).select(F.struct(F.col("version").alias("stats_version"), F.lit(algorithm).alias("algo_version"), params.alias("params"), F.struct(F.col("n").alias("N")).alias("corpus")).alias("r"))
    weights = salience(postings).select("card_id", "concept_id", F.struct("card_id", "concept_id", "weight").alias("r"))
    pairs = cooccurrence(postings, k_cooc, min_cooc).where("outcome = 'kept'").select("concept_a", "concept_b", F.struct("concept_a", "concept_b", F.col("pmi").alias("ppmi"), "cooc_count").alias("r"))
    rows = head.select(F.lit("head").alias("section"), F.lit("").alias("a"), F.lit("").alias("b"), F.to_json("r").alias("line"))
    for name, frame, a, b in (("salience", weights, "card_id", "concept_id"), ("pairs", pairs, "concept_a", "concept_b")):
        rows = rows.unionAll(frame.select(F.lit(name), F.col(a).cast("string"), F.col(b).cast("string"), F.to_json("r")))
    return rows


def write_report(rows: DataFrame, folder: str) -> None:
    """The lines as text files that are in order one after the other: the head, pairs, salience."""
    rows.orderBy("section", "a", "b").select("line").write.text(folder)
