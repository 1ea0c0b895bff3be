"""Registry rows, surfaces, verdicts and pages: keyed merges and small transforms of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T

# The regime and the trust that a source has by its type, where none is given.
TYPE_REGIME = {
    "peer_reviewed": "empirical", "textbook": "empirical", "reference": "empirical",
    "novel": "fictional", "fiction": "fictional", "essay": "interpretive",
    "history": "historical", "web": "empirical", "unknown": "empirical",
    "pdf": "empirical", "epub": "empirical", "html": "empirical",
    "text": "empirical", "wikipedia": "empirical",
    "conceptnet": "conventional", "atomic": "conventional", "glucose": "conventional",
    "causenet": "conventional",
}
TYPE_TRUST = {
    "peer_reviewed": 0.9, "textbook": 0.8, "reference": 0.7, "history": 0.6,
    "essay": 0.5, "novel": 0.4, "fiction": 0.4, "web": 0.3, "unknown": 0.25,
    "wikipedia": 0.7, "pdf": 0.5, "epub": 0.5, "html": 0.4, "text": 0.4,
    "conceptnet": 0.2, "atomic": 0.2, "glucose": 0.2,
    "causenet": 0.4,
}
OTHER_TRUST, OTHER_REGIME = 0.25, "empirical"
#: Sections of pages that a banner must be on, by share and at least, and lines looked at from each edge.
BANNER_SHARE, BANNER_LEAST, EDGE, FEWEST_PAGES = 0.3, 3, 2, 6
#: Least confidence of a linker's verdict.
RELATED_GATE, OTHER_GATE = 0.75, 0.60


def _by_type(table: dict, default) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, "source_type"), F.lit(default))


def register_sources(known: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of (doc_id, source_type, trust_weight, regime, licence, bundle).

    A new source has the trust and regime of its type where none is given; a known one keeps
    its own then, as it may have been edited.  Licence (by its known id) and bundle fill what
    was empty.
    """
    a, b = known.alias("a"), new.withColumns({"source_type": F.lower("source_type"), "licence": F.when(F.col("licence").isNotNull(), T.licence(F.col("licence")))}).alias("b")
    both = a.join(b, F.col("a.doc_id") == F.col("b.doc_id"), "full")
    kept = lambda c: F.when(F.coalesce(F.col(f"a.{c}"), F.lit("")) != "", F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    first = F.col("a.doc_id").isNull()
    rows = both.select(
        F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.coalesce("b.source_type", "a.source_type", F.lit("unknown")).alias("source_type"),
        F.coalesce("b.trust_weight", "a.trust_weight").alias("t"), F.coalesce("b.regime", "a.regime").alias("r"), first.alias("first"), kept("licence"), kept("bundle"),
    )
    typed = lambda table, other: F.when(F.col("first"), _by_type(table, other))
    return rows.select("doc_id", "source_type", F.coalesce("t", typed(TYPE_TRUST, OTHER_TRUST)).alias("trust_weight"), F.coalesce("r", typed(TYPE_REGIME, OTHER_REGIME)).alias("regime"), "licence", "bundle")


def sources_by_licence(sources: DataFrame, licence: str | None = None, holder: str | None = None, permission: str | None = None) -> DataFrame:
    """Registry rows of a licence (by its known id), with a holder's name in theirs, and that grant a permission: all that are given."""
    rows = sources
    if licence:
        rows = rows.where(T.licence(F.col("licence")) == T.licence(F.lit(licence)))
    if holder:
        rows = rows.where(F.contains(F.lower(F.coalesce("licence_holder", F.lit(""))), F.lit(holder.lower())))
    return rows.where(F.coalesce(T.licence_flag(F.col("licence"), permission), F.lit(False))) if permission else rows


def set_source(known: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Edits overwrite every field that they set."""
    fields = [c for c in edits.columns if c != key]
    new = edits.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    rows = known.join(new, key, "left")
    return rows.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in known.columns])


def insert_absent(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Known rows, and new ones whose key is not known, once."""
    return known.unionByName(new.dropDuplicates([key]).join(known.select(key), key, "left_anti"))


def verdict_edges(verdicts: DataFrame) -> DataFrame:
    """(src, dst, type) of linker verdicts (a, b, relation, confidence) that pass their gate; the rest is checkpointed only."""
    gate = F.when(F.col("relation") == "related", RELATED_GATE).otherwise(OTHER_GATE)
    passed = verdicts.where((F.col("relation") != "none") & (F.col("confidence") >= gate))
    turned = F.col("relation").isin("part_of_inverse", "is_a_inverse")
    return passed.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("dst"), F.regexp_replace("relation", "_inverse$", "").alias("type"))


def patched(drafts: DataFrame, verdicts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Drafts after verification: no verdict accepts, reject drops, adjust overlays the fields that it sets."""
    v = verdicts.select(key, "verdict", *[F.col(c).alias(f"_{c}") for c in fields])
    rows = drafts.join(v, key, "left").where("verdict is null or verdict <> 'reject'")
    return rows.select(*[F.when(F.col("verdict") == "adjust", F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in drafts.columns])


def page_furniture(pages: DataFrame) -> DataFrame:
    """(doc, page, line_no, line) of (doc, page, text) without banners and page numbers at page edges.

    A banner is a line, digits alike, at the edge of enough of the document's pages; documents of
    few pages stay as they are.
    """
    rows = pages.select("doc", "page", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    full = F.btrim("line") != ""
    top, low = Window.partitionBy("doc", "page").orderBy("line_no"), Window.partitionBy("doc", "page").orderBy(F.desc("line_no"))
    marked = rows.withColumn("up", F.sum(full.cast("int")).over(top)).withColumn("down", F.sum(full.cast("int")).over(low))
    marked = marked.withColumn("edge", full & ((F.col("up") <= EDGE) | (F.col("down") <= EDGE))).withColumn("form", F.lower(F.regexp_replace(F.btrim("line"), "[0-9]+", "#")))
    sizes = pages.groupBy("doc").agg(F.countDistinct("page").alias("n_pages"))
    seen = marked.where("edge").groupBy("doc", "form").agg(F.countDistinct("page").alias("n")).join(sizes, "doc")
    banners = seen.where((F.col("n_pages") >= FEWEST_PAGES) & (F.col("n") >= F.greatest(F.lit(BANNER_LEAST), F.floor(BANNER_SHARE * F.col("n_pages"))))).select("doc", "form", F.lit(True).alias("edge"))
    left = marked.join(banners, ["doc", "form", "edge"], "left_anti").join(sizes, "doc")
    number = F.col("edge") & F.btrim("line").rlike("^[-–— ]*[0-9]{1,4}[-–— ]*$") & (F.col("n_pages") >= FEWEST_PAGES)
    return left.where(~number).select("doc", "page", "line_no", "line")


def pending_chunks(chunks: DataFrame, distilled: DataFrame, bundle: str | None = None, skipped_zones: tuple[str, ...] = ("references", "toc", "index", "boilerplate"), dedupe: bool = True) -> DataFrame:
    """Chunks (id, bundle, section, text [, zone]) with zone, owner and fate, the first that holds: outside, done, zone, duplicate or pending.

    Chunks that carry a zone keep it; others get theirs by heading and text.
    A text is owned by the chunk of the smallest id that has it: among distilled ones, else among
    those that are neither outside nor in a skipped zone.  Counting fates gives the four counters.
    """
    rows = (chunks if "zone" in chunks.columns else chunks.withColumn("zone", T.zone(F.col("section"), F.col("text")))).withColumn("_hash", T.text_hash(F.col("text")))
    rows = rows.join(distilled.select("id", F.lit(True).alias("_done")).distinct(), "id", "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    outside = F.lit(False) if bundle is None else ~F.col("bundle").eqNullSafe(bundle)
    rows = rows.withColumn("_out", outside).withColumn("_skip", F.col("zone").isin(list(skipped_zones)))
    first = F.min(F.struct((~F.col("_done")).alias("waits"), "id"))
    owners = rows.where("_done or not (_out or _skip)").groupBy("_hash").agg(first["id"].alias("owner"))
    rows = rows.join(owners, "_hash", "left")
    fate = F.when(F.col("_out"), "outside").when(F.col("_done"), "done").when(F.col("_skip"), "zone")
    if dedupe:
        fate = fate.when(F.col("owner") != F.col("id"), "duplicate")
    return rows.withColumn("fate", fate.otherwise("pending")).select(*[c for c in chunks.columns if c != "zone"], "zone", F.when(F.col("fate") == "duplicate", F.col("owner")).alias("owner"), "fate")


def slices(sections: DataFrame, chars: int, least: int = 40, most: int | None = None) -> DataFrame:
    """(id, off, piece) of (id, text): cut every ``chars`` characters, short pieces dropped; to the end, or ``most`` at most."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.char_length("text") / chars).cast("int") - 1))
    offs = F.transform(starts, lambda i: i * chars)
    cut = sections.select("id", F.explode_outer(offs if most is None else F.slice(offs, 1, most)).alias("off"), "text")
    return cut.select("id", "off", F.substring("text", F.col("off") + 1, F.lit(chars)).alias("piece")).where(F.char_length("piece") >= least)
