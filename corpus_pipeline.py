"""A training-data pipeline over ``documents``: clean, deduplicate, decontaminate, pack.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its
result is written and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.decontaminate import drop_contaminated
from lorewell.llm.graph import hinted, saved
from lorewell.llm.jaccard_join import shingle_components
from lorewell.llm.line_dedup import drop_repeated_lines
from lorewell.llm.packing import pack_documents
from lorewell.llm.quality_rules import keep_clean
from lorewell.llm.queries import vocabulary_path
from lorewell.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and so do the documents that are rejected (null and empty texts among them)."""
    return keep_clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and so do documents that lost lines and have no word left; a null id keeps its text."""
    out = drop_repeated_lines(docs).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that shares five-word shingles at a similarity of 0.8, the smallest id stays.

    Cases: documents without words and those with a null id stay; rows of one id stay or go together.
    """
    groups = shingle_components(docs, n=5, percent=80)
    lost = saved(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(hinted(lost), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, short items included; null and empty texts hold none and stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, dealt to sequences; a null or empty text is its end id alone."""
    return pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]
#: Packing works on token ids, which SQL cannot make; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one is written."""
    docs, drop = spark.read.parquet(f"{sf_dir}/documents.parquet"), lambda: None
    for _, stage in STAGES[:-1]:
        last = drop
        docs, drop = written(stage(spark, docs, sf_dir))
        last()
    return STAGES[-1][1](spark, docs, sf_dir)
