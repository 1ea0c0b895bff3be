"""Files, chunk lookups, bundles and vectors of a library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lorewell.functions import text as T
from lorewell.operators import search

# The extractor of each file extension, and the metadata that chunks may carry.
EXTRACTORS = {"pdf": "pdf", "epub": "epub", "html": "html", "htm": "html", "txt": "text", "md": "text"}
DIM = 64


def extractor_for(path: Column) -> Column:
    """The extractor of a path by its lower-cased extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in EXTRACTORS.items() for x in pair])[ext]


def read_library(spark: SparkSession, root: str) -> DataFrame:
    """(path, extractor, content_hash, modified, content) of all files below a folder that have an extractor."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", extractor_for(F.col("path")).alias("extractor"), F.sha1("content").alias("content_hash"), F.col("modificationTime").alias("modified"), "content").where("extractor is not null")


def resumable(articles: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Articles (path) that no manifest row (path, status, version) marks as ok at this version."""
    return articles.join(done.where((F.col("status") == "ok") & (F.col("version") == version)).select("path"), "path", "left_anti")


def with_meta(chunks: DataFrame, meta: DataFrame, keys: list[str], key: str = "path") -> DataFrame:
    """Chunks with the listed metadata of their document where it is set; other columns of it are ignored."""
    extra = meta.select(key, *[F.col(k).alias(f"_{k}") for k in keys])
    rows = chunks.join(extra, key, "left")
    for k in keys:
        rows = rows.withColumn(k, F.coalesce(f"_{k}", k) if k in chunks.columns else F.col(f"_{k}")).drop(f"_{k}")
    return rows


def chunk_filter(chunks: DataFrame, source_type: str | None = None, title: str | None = None) -> DataFrame:
    """Chunks of a type whose title holds a piece of text, without regard to case."""
    rows = chunks if source_type is None else chunks.where(F.col("source_type") == source_type)
    return rows if title is None else rows.where(F.contains(F.lower("title"), F.lit(title.lower())))


def page_after(chunks: DataFrame, last, n: int, key: str = "id") -> DataFrame:
    """The next n rows by key after the last one seen (this operator's purpose); None starts."""
    rows = chunks if last is None else chunks.where(F.col(key) > last)
    return rows.orderBy(key).limit(n)


def sample(chunks: DataFrame, n: int, source_type: str | None = None, seed: int = 0) -> DataFrame:
    """n rows drawn at random (this operator's purpose), the same ones for a seed."""
    return chunk_filter(chunks, source_type).withColumn("_r", F.xxhash64(F.lit(seed), "id")).orderBy("_r", "id").limit(n).drop("_r")


def hash_vectors(frame: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, vec): unit vectors of hashed terms, a stand-in for an embedding service; null vectors for texts without terms."""
    bucket = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim

    @F.pandas_udf(ArrayType(DoubleType()))
    def spread(buckets: pd.Series) -> pd.Series:
        def one(b):
            v = np.bincount(np.asarray(b, np.int64), minlength=dim).astype(float)
            return v / np.sqrt(v @ v) if len(b) else None

        return buckets.map(one)

    return frame.select(key, spread(F.transform(T.terms(F.col(text)), bucket)).alias("vec"))


def embed_missing(nodes: DataFrame, dim: int = DIM) -> DataFrame:
    """Nodes (id, label, summary, status, embedding) with a vector of label and summary where an active one has none."""
    text = F.concat(F.col("label"), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(". "), F.col("summary"))).otherwise(""))
    wanted = nodes.where("embedding is null and status = 'active'").select("id", text.alias("_text"))
    made = hash_vectors(wanted, "id", "_text", dim).withColumnRenamed("vec", "_vec")
    return nodes.join(made, "id", "left").withColumn("embedding", F.coalesce("embedding", "_vec")).select(nodes.columns)


def chunks_for_path(chunks: DataFrame, vectors: DataFrame, path: str) -> DataFrame:
    """(seq, section, text, tokens, vec) of one document, in order, with the vectors that there are."""
    rows = chunks.where(F.col("path") == path).select("id", "seq", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    return rows.join(vectors.select("id", "vec"), "id", "left").orderBy("seq", "id").select("seq", "section", "text", "tokens", "vec")


def nearest(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score): the nearest vector of each query, the smaller id of equal ones.

    Each task sends one candidate a query.
    """
    scored = search.scored_vectors(vectors.select("id", "vec"), queries, 1)
    best = scored.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("id")).alias("m"))).alias("b"))
    return best.select("query_id", (-F.col("b.m")).alias("id"), "b.score")


def target_search(arms: list[DataFrame], active: DataFrame, k: int = 10, floor: float = 0.35) -> DataFrame:
    """(query_id, kind, id, score, rank): the best score of each target over arms (query_id, kind, id, score), active ones alone."""
    rows = arms[0]
    for more in arms[1:]:
        rows = rows.unionByName(more)
    best = rows.where(F.col("score") >= floor).groupBy("query_id", "kind", "id").agg(F.max("score").alias("score"))
    return search.top_k(best.join(active.select("kind", "id"), ["kind", "id"], "left_semi"), k)


def card_scores(ranked: DataFrame) -> DataFrame:
    """(query_id, id, score) of ranked cards: one over the rank from 1, to four digits."""
    return ranked.select("query_id", "id", F.round(1 / (1 + F.col("rank")), 4).alias("score"))


def source_window(chunks: DataFrame, best: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """Chunks (key, seq, text) of each document that fit a budget of characters round its best chunk (key, seq).

    All of a document that fits; else a run that grows one chunk forward, then one back, until
    the budget is reached.  The run is found from running sums: after step i the window holds
    the best chunk, its i next and its i previous ones.
    """
    whole = Window.partitionBy(key)
    rows = chunks.join(best.select(key, F.col("seq").alias("_best")), key, "left").withColumn("_best", F.coalesce("_best", F.min("seq").over(whole)))
    n = F.char_length("text").cast("long")
    # The order of growth: 0 the best chunk, 2i - 1 the i-th after it, 2i the i-th before it.
    away = F.col("seq") - F.col("_best")
    rows = rows.withColumn("_n", n).withColumn("_step", F.when(away > 0, 2 * away - 1).otherwise(-2 * away))
    before = F.sum("_n").over(whole.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("_before", F.coalesce(before, F.lit(0))).where((F.col("_before") < budget) | (F.col("_step") == 0))
    return kept.select(*chunks.columns)


def regime_facets(items: DataFrame, modal: DataFrame, key: str) -> DataFrame:
    """(key, axis, value): the epistemic facet, an item's regime or else the modal one of its support."""
    rows = items.select(key, "regime").join(modal.select(key, F.col("regime").alias("_modal")), key, "left")
    return rows.select(key, F.lit("epistemic").alias("axis"), F.coalesce("regime", "_modal").alias("value")).where("value is not null")


def inspect_bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of a bundle, a row each."""
    counts = [frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, frame in tables.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionAll(more)
    return out


def export_bundle(tables: dict[str, DataFrame], folder: str, name: str, model: str) -> None:
    """Writes each table as Parquet below a folder, and last a manifest (bundle, model, table, rows).

    A folder without a manifest is an export that did not end.
    """
    for table, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{table}")
    spark = next(iter(tables.values())).sparkSession
    written = inspect_bundle({t: spark.read.parquet(f"{folder}/{t}") for t in tables})
    written.select(F.lit(name).alias("bundle"), F.lit(model).alias("model"), "table", "rows").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def migrate_vocabulary(frame: DataFrame, columns: dict[str, str], values: dict[str, dict[str, str]]) -> DataFrame:
    """Renamed columns, and old values of (renamed) columns as new ones; other values stay."""
    out = frame.withColumnsRenamed(columns)
    for c, to in values.items():
        out = out.withColumn(c, F.coalesce(F.create_map(*[F.lit(x) for pair in to.items() for x in pair])[F.col(c)], F.col(c)))
    return out
