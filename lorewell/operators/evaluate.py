"""Retrieval quality: recall, nDCG, abstention rates, percentiles and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELEVANT = 2
#: Gates of false confidence and of correctness outside the graph.
MAX_FALSE_CONFIDENCE, MIN_OUTSIDE = 0.02, 0.90


def recall_at_k(results: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """(query_id, recall) of results (query_id, id, rank from 0) for queries with a relevant judgment."""
    good = judgments.where(F.col("grade") >= RELEVANT)
    top = results.where(F.col("rank") < k).select("query_id", "id", F.lit(1).alias("hit"))
    return good.join(top, ["query_id", "id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def ndcg_at_k(results: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) with gains 2^grade - 1; null for queries without a relevant judgment."""
    from pyspark.sql import Window

    gain = lambda rank: (F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(rank + 2.0)
    dcg = results.where(F.col("rank") < k).join(judgments, ["query_id", "id"], "left").groupBy("query_id").agg(F.sum(gain(F.col("rank"))).alias("dcg"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = judgments.withColumn("r", F.row_number().over(w) - 1).where(F.col("r") < k).groupBy("query_id").agg(F.sum(gain(F.col("r"))).alias("idcg"), F.max("grade").alias("best"))
    return ideal.where(F.col("best") >= RELEVANT).join(dcg, "query_id", "left").select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"), 6).alias("ndcg"))


def abstention(outcomes: DataFrame) -> DataFrame:
    """One row of rates over (tier, top_grade, answerable, outside): tiers 3 and 4 abstain, tier 1 is confident."""
    held = F.col("tier") >= 3
    rate = lambda hit, of: F.round(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), 4)
    sums = outcomes.agg(
        F.count("*").alias("n"), F.coalesce(rate(F.col("top_grade") <= 1, F.col("tier") == 1), F.lit(0.0)).alias("false_confidence"),
        rate(held, F.col("outside")).alias("outside_correct"), rate(held, F.col("answerable")).alias("overreach"),
    )
    return sums.withColumn("accepted", (F.col("false_confidence") <= MAX_FALSE_CONFIDENCE) & (F.coalesce("outside_correct", F.lit(1.0)) >= MIN_OUTSIDE))


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, p50, p95, n), linearly interpolated."""
    return rows.groupBy(by).agg(F.round(F.percentile(value, 0.5), 1).alias("p50"), F.round(F.percentile(value, 0.95), 1).alias("p95"), F.count("*").alias("n"))


def fit_verdict(models: DataFrame, budget_gb: float) -> DataFrame:
    """Adds fits: the weights with a tenth more and 2 GB are within nine tenths of the budget."""
    need = F.col("weights_gb") * 1.1 + 2
    return models.withColumn("need_gb", need).withColumn("fits", need <= 0.9 * budget_gb)


def gold_marks(gold: DataFrame) -> DataFrame:
    """Gold questions (id, category, judgments) with the relevant cards, in order, and whether they are answerable: in the graph, with one."""
    good = F.map_keys(F.map_filter("judgments", lambda _, grade: grade >= RELEVANT))
    return gold.withColumn("relevant", F.sort_array(good)).withColumn("answerable", (F.col("category") != "out_of_graph") & (F.size("relevant") > 0))


def tier_histogram(outcomes: DataFrame) -> DataFrame:
    """(tier, n, share) of the four tiers, those without an outcome too."""
    tiers = outcomes.sparkSession.range(1, 5).select(F.col("id").cast("int").alias("tier"))
    counted = tiers.join(outcomes.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    total = outcomes.agg(F.count("*").alias("all"))
    return counted.crossJoin(F.broadcast(total)).select("tier", "n", F.round(F.coalesce(F.col("n") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0)), 4).alias("share"))
