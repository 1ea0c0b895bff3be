"""Answer quality: evidence strength, confidence bands, fit, facets and licences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.session import saved

HIGH, MEDIUM = 0.66, 0.40
SECTION_LIMIT = 6


def strength(support: DataFrame, key: str, pressure: DataFrame | None = None) -> DataFrame:
    """(key, strength): the largest trust of each evidence cluster, summed and saturated, less half the pressure."""
    clusters = support.groupBy(key, F.coalesce("evidence_cluster", "doc_id").alias("c")).agg(F.max(F.coalesce("trust_weight", F.lit(0.0))).alias("t"))
    base = clusters.groupBy(key).agg((1 - F.exp(-F.round(F.sum("t"), 9) / 2)).alias("base"))
    rows = base.withColumn("p", F.lit(0.0)) if pressure is None else base.join(pressure.select(F.col("edge").alias(key), F.col("pressure").alias("p")), key, "left").fillna({"p": 0.0})
    return rows.select(key, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base") - 0.5 * F.col("p"))), 6).alias("strength"))


def grounding(top: DataFrame, gated: bool = False) -> DataFrame:
    """Adds confidence and band to top items (score, n_support, kind, contradicted [, fit, clash])."""
    structured = F.when(F.col("kind").isin("node", "edge", "card"), 0.2).otherwise(0.0)
    conf = F.least(F.lit(1.0), 0.5 * F.coalesce("score", F.lit(0.0)) + 0.3 * F.least(F.lit(1.0), F.col("n_support") / 2) + structured)
    clash = F.lit(False)
    if gated:
        conf, clash = conf * (0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fit")))), F.col("clash")
    band = F.when(F.col("contradicted"), "contra").when(clash, "none").when(conf >= HIGH, "high").when(conf >= MEDIUM, "medium").when(conf > 0, "low").otherwise("none")
    return top.withColumn("band", band).withColumn("confidence", F.floor(conf * 10000 + 0.5) / 10000)


def tier(band: Column) -> Column:
    """Bands to tiers: confident, hedged, associative, abstain."""
    return F.when(band == "high", 1).when(band == "medium", 2).when(band == "low", 3).otherwise(4)


def _same_sets(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, set) and (set, feature, values): equal sets of features are one, named by their hash; null values are left out."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("feature", "value"))).alias("s")).withColumn("set", F.sha2(F.to_json("s"), 256))
    content = sets.groupBy("set").agg(F.first("s").alias("s")).select("set", F.explode("s").alias("f"))
    return sets.select(key, "set"), content.groupBy("set", "f.feature").agg(F.collect_list("f.value").alias("values"))


#: Ids of a set that one task takes at once, and rows that a task makes of them and its queries or so.
PIECE, TASK_ROWS = 256, 2_000_000


def feature_overlap(wanted: DataFrame, has: DataFrame) -> DataFrame:
    """(query_id, id, overlap) of features (query_id, feature, value) and (id, feature, value): a clash costs half a match.

    Sets of features are scored against sets, once for all that have equal ones; ids meet by their sets alone.
    A set of many ids is cut into pieces, and as many tasks make the rows as there are millions of them.
    """
    (asked, want), (held, own) = _same_sets(wanted, "query_id"), _same_sets(has, "id")
    asked, held = saved(asked), saved(held)
    n = want.groupBy("set").agg(F.count("feature").alias("n"))
    compared = (F.size("values") > 0) & (F.size("own") > 0)
    m = F.when(compared, F.arrays_overlap("values", "own").cast("int"))
    match = want.join(own.select(F.col("set").alias("other"), "feature", F.col("values").alias("own")), "feature").select("set", "other", m.alias("m"))
    sums = match.groupBy("set", "other").agg(F.sum("m").alias("hits"), F.sum(1 - F.col("m")).alias("misses")).join(n, "set")
    scored = saved(sums.select("set", "other", F.round(F.greatest(F.lit(0.0), (F.col("hits") - 0.5 * F.col("misses")) / (F.col("n") + 1e-6)), 6).alias("overlap")))
    sizes = held.groupBy(F.col("set").alias("other")).agg(F.count("*").alias("ids"))
    pieces = sizes.select("other", "ids", F.ceil(F.col("ids") / PIECE).cast("int").alias("pieces"))
    rows = scored.join(asked.groupBy("set").agg(F.count("*").alias("asked")), "set").join(sizes, "other").agg(F.sum(F.col("asked") * F.col("ids"))).first()[0]
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // TASK_ROWS))
    piece = F.pmod(F.xxhash64("id"), "pieces").cast("int").alias("piece")
    left = scored.join(asked, "set").join(pieces, "other").select("query_id", "other", "overlap", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    right = held.withColumnRenamed("set", "other").join(pieces, "other").select("id", "other", piece)
    return left.repartition(parts, "other", "piece").join(right.repartition(parts, "other", "piece"), ["other", "piece"]).select("query_id", "id", "overlap")


def facet_filter(items: DataFrame, facets: DataFrame, required: dict[str, list], exclude: dict[str, list] | None = None) -> DataFrame:
    """Items without a clash: an item with values on a required axis needs one of those asked for; one on an excluded value goes."""
    test = lambda axes: F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(v).alias("value")) for a, vs in axes.items() for v in vs])
    out = items
    if required:
        rows = facets.where(F.col("axis").isin(list(required)))
        good = F.max(F.array_contains(test(required), F.struct("axis", "value")).cast("int"))
        bad = rows.groupBy("id", "axis").agg(good.alias("ok")).where("ok = 0").select("id").distinct()
        out = out.join(bad, "id", "left_anti")
    if exclude:
        out = out.join(facets.where(F.array_contains(test(exclude), F.struct("axis", "value"))).select("id").distinct(), "id", "left_anti")
    return out


def facet_counts(facets: DataFrame) -> DataFrame:
    return facets.groupBy("axis", "value").agg(F.count("*").alias("n"))


# Regimes that are epistemic values. Bundles that are no subject are a parameter.
EPISTEMIC = ("empirical", "conventional", "fictional", "interpretive", "historical")
NO_SUBJECT = ("base", "research", "overlay", "")


def trust_facets(support: DataFrame, key: str) -> DataFrame:
    """(key, axis, value): the trust tier by the largest trust."""
    most = support.where("trust_weight is not null").groupBy(key).agg(F.max("trust_weight").alias("t"))
    return most.select(key, F.lit("trust_tier").alias("axis"), F.when(F.col("t") >= HIGH, "high").when(F.col("t") >= MEDIUM, "medium").otherwise("low").alias("value"))


def derive_facets(items: DataFrame, support: DataFrame, sources: DataFrame, key: str, no_subject: tuple[str, ...] = NO_SUBJECT) -> DataFrame:
    """(key, axis, value) of items (key, regime, status, volatility): what their rows and support say, no more.

    epistemic: the item's regime, else the most frequent of its support (the first in order of
    equal ones).  trust_tier: by the largest trust.  domain: the bundles of its sources that are
    subjects.  time_frame: superseded, historical, timeless (no volatility), or current where
    there is support.
    """
    form = lambda c: F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    known = support.select(key, form("regime").alias("regime")).where(F.col("regime").isin(list(EPISTEMIC))).groupBy(key, "regime").agg(F.count("*").alias("n"))
    modal = known.groupBy(key).agg(F.min_by("regime", F.struct(-F.col("n"), F.col("regime"))).alias("modal"))
    own = F.when(form("regime").isin(list(EPISTEMIC)), form("regime"))
    rows = lambda axis, frame, value: frame.select(key, F.lit(axis).alias("axis"), value.alias("value")).where("value is not null")
    epistemic = rows("epistemic", items.join(modal, key, "left"), F.coalesce(own, "modal"))
    bundle = form("bundle")
    domain = support.join(sources.select("doc_id", bundle.alias("b")), "doc_id").where(~F.col("b").isin(list(no_subject))).select(key, "b").distinct()
    backed = items.join(support.select(key, F.lit(True).alias("backed")).distinct(), key, "left")
    time = F.when(form("status") == "superseded", "superseded").when(form("regime") == "historical", "historical").when(F.col("volatility") <= 1e-6, "timeless").when(F.col("backed"), "current")
    return reduce(DataFrame.unionByName, [epistemic, trust_facets(support, key).join(items.select(key), key, "left_semi"), rows("domain", domain.join(items.select(key), key, "left_semi"), F.col("b")), rows("time_frame", backed, time)])


def set_facets(facets: DataFrame, new: DataFrame) -> DataFrame:
    """Values of an item on an axis, all replaced by the new ones."""
    return facets.join(new.select("id", "axis").distinct(), ["id", "axis"], "left_anti").unionByName(new)


def facets_of(items: DataFrame, facets: DataFrame) -> DataFrame:
    """(id, facets) of the items asked for: a map of each axis to its values, in order; empty for an item without."""
    own = facets.join(items.select("id").distinct(), "id", "left_semi").groupBy("id", "axis").agg(F.sort_array(F.collect_set("value")).alias("values"))
    maps = own.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("axis", "values")))).alias("facets"))
    return items.select("id").distinct().join(maps, "id", "left").select("id", F.coalesce("facets", F.create_map().cast(maps.schema["facets"].dataType)).alias("facets"))


def combine_licences(rows: DataFrame, key: str, permissions: list[str], conditions: list[str]) -> DataFrame:
    """Permissions hold if all hold (false wins over unknown), conditions if any does; and the distinct ids."""
    every = [F.when(F.max((~F.col(p)).cast("int")) == 1, False).when(F.count_if(F.col(p).isNull()) > 0, None).otherwise(True).alias(p) for p in permissions]
    some = [F.when(F.max(F.col(c).cast("int")) == 1, True).when(F.count_if(F.col(c).isNull()) > 0, None).otherwise(False).alias(c) for c in conditions]
    return rows.groupBy(key).agg(*every, *some, F.array_join(F.array_sort(F.collect_set("licence")), " + ").alias("licences"))


def first_wins(*pools: DataFrame) -> DataFrame:
    """The union of pools (kind, id, score), the first pool that has an item keeping it."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("pool", F.lit(i)) for i, p in enumerate(pools)])
    w = Window.partitionBy("kind", "id").orderBy("pool", F.desc("score"))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def frame(items: DataFrame, limit: int = SECTION_LIMIT) -> DataFrame:
    """(query_id, section, ids): the best items of each section, up to the limit."""
    w = Window.partitionBy("query_id", "section").orderBy(F.desc("score"), "id")
    top = items.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return top.groupBy("query_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
