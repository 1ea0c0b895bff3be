"""Provenance: bundles, closures of documents, and the removal of what they alone support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRUST_CAP = 0.35


def select_sources(sources: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, unloaded: list[str] | None = None) -> DataFrame:
    """Registry rows whose bundle, id or title is included (``*``: all) and not excluded, retracted or unloaded."""
    hit = lambda names: F.col("bundle").isin(names) | F.col("doc_id").cast("string").isin(names) | F.col("title").isin(names)
    rows = sources.where(F.coalesce(F.col("status") != "retracted", F.lit(True)))
    if include and "*" not in include:
        rows = rows.where(F.coalesce(hit(include), F.lit(False)))
    if exclude:
        rows = rows.where(~F.coalesce(hit(exclude), F.lit(False)))
    return rows.where(~F.coalesce(F.col("bundle").isin(unloaded), F.lit(False))) if unloaded else rows


def ownership(support: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, owned): all, some or none of an item's support is in the documents."""
    rows = support.join(docs.select("doc_id", F.lit(1).alias("in_")), "doc_id", "left")
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.count("in_").alias("k"))
    return sums.select(key, F.when(F.col("k") == F.col("n"), "all").when(F.col("k") > 0, "some").otherwise("none").alias("owned"))


def remove_docs(edges: DataFrame, edge_support: DataFrame, node_support: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges left, support left, nodes gone) after the documents are removed.

    Edges of their support alone go; others lose those entries.  Nodes of their support alone go
    unless an edge that is left still names them.
    """
    owned = ownership(edge_support, docs, "edge_id").where("owned = 'all'").select("edge_id")
    left = edges.join(owned, "edge_id", "left_anti")
    support = edge_support.join(docs.select("doc_id"), "doc_id", "left_anti")
    ends = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
    gone = ownership(node_support, docs, "node").where("owned = 'all'").select("node").join(ends, "node", "left_anti")
    return left, support, gone


def closure(edges: DataFrame, edge_support: DataFrame, node_support: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, borrowed): nodes the documents support, and those that only their edges name."""
    ids = docs.select("doc_id")
    own = _supported(edges, edge_support.join(ids, "doc_id", "left_semi"))
    return _nodes(own, node_support.join(ids, "doc_id", "left_semi"))


def _supported(edges: DataFrame, support: DataFrame) -> DataFrame:
    return edges.join(support.select("edge_id").distinct(), "edge_id", "left_semi")


def _nodes(edges: DataFrame, node_support: DataFrame) -> DataFrame:
    """(node, borrowed): one grouping says which are borrowed, so that neither side is made twice."""
    named = edges.select(F.explode(F.array("src", "dst")).alias("node"), F.lit(True).alias("borrowed"))
    return node_support.select("node", F.lit(False).alias("borrowed")).unionAll(named).groupBy("node").agg(F.bool_and("borrowed").alias("borrowed"))


def merge_tables(own: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of the other table whose key is new, on the columns that both have; own rows stay as they are."""
    shared = [c for c in other.columns if c in own.columns]
    return own.unionByName(other.select(shared).dropDuplicates([key]).join(own.select(key), key, "left_anti"), allowMissingColumns=True)


def split_bundles(sources: DataFrame, edges: DataFrame, edge_support: DataFrame, node_support: DataFrame) -> DataFrame:
    """(bundle, node, borrowed) of every bundle's closure at once: nodes its documents support, and those only its edges name.

    One plan splits all bundles; writing it partitioned by bundle gives a folder each.
    """
    own = sources.select("doc_id", "bundle")
    mine = node_support.join(own, "doc_id").select("bundle", "node").distinct()
    kept = edge_support.join(own, "doc_id").select("bundle", "edge_id").distinct().join(edges, "edge_id")
    named = kept.select("bundle", F.col("src").alias("node")).union(kept.select("bundle", "dst")).distinct()
    borrowed = named.join(mine, ["bundle", "node"], "left_anti").select("bundle", "node", F.lit(True).alias("borrowed"))
    return mine.select("bundle", "node", F.lit(False).alias("borrowed")).unionAll(borrowed)


def assemble(sources: DataFrame, edges: DataFrame, edge_support: DataFrame, node_support: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, unloaded: list[str] | None = None) -> dict[str, DataFrame]:
    """The working tables of a selection of sources: sources, edges, edge_support and nodes of its closure.

    Support by other documents is left out, as their sources are.
    """
    chosen = select_sources(sources, include, exclude, unloaded)
    docs = chosen.select("doc_id")
    # Support that names no edge is apart, so that the rest is the same rows wherever it is joined and is shuffled once.
    support, other = (edge_support.where(c).join(docs, "doc_id", "left_semi") for c in ("edge_id is not null", "edge_id is null"))
    own = _supported(edges, support)
    return {"sources": chosen, "edges": own, "edge_support": support.unionAll(other), "nodes": _nodes(own, node_support.join(docs, "doc_id", "left_semi"))}


def eject(sources: DataFrame, edges: DataFrame, edge_support: DataFrame, node_support: DataFrame, bundle: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(the bundle's own tables, to be exported first; what is left without it), by the rules of :func:`remove_docs`."""
    exported = assemble(sources, edges, edge_support, node_support, [bundle])
    docs = sources.where(F.col("bundle") == bundle).select("doc_id")
    left, support, gone = remove_docs(edges, edge_support, node_support, docs)
    return exported, {"sources": sources.join(docs, "doc_id", "left_anti"), "edges": left, "edge_support": support, "gone": gone}


def strip_vectors(rows: DataFrame, model: str, own_model: str, column: str = "embedding") -> DataFrame:
    """Rows of a bundle without their vectors, if another model made them."""
    return rows if model == own_model else rows.withColumn(column, F.lit(None).cast(rows.schema[column].dataType))


def import_bundle(own: DataFrame, bundle: DataFrame, name: str, cap: float = TRUST_CAP) -> DataFrame:
    """Registry rows of a bundle under its name, with capped trust; rows known already are untouched."""
    return merge_tables(own, bundle.withColumn("bundle", F.lit(name)).withColumn("trust_weight", F.least("trust_weight", F.lit(cap))), "doc_id")


def bundle_summary(sources: DataFrame) -> DataFrame:
    """(bundle, n_sources, trust, titles) with the titles joined in order."""
    name = F.coalesce(F.when(F.col("bundle") != "", F.col("bundle")), F.lit("(none)"))
    return sources.groupBy(name.alias("bundle")).agg(F.count("*").alias("n_sources"), F.max("trust_weight").alias("trust"), F.array_join(F.array_sort(F.collect_set("title")), "\u001f").alias("titles"))
