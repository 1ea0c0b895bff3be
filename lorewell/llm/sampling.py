"""Training rows for the classifiers: which documents may be learnt from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.graph import hinted

#: Bytes of text that a model learns from: texts are taken whole, by hash of their ids, until so many are; the first of each class always is.
SAMPLE_BYTES = 32_000_000


def held_out(id_col: str = "doc_id") -> Column:
    """The documents that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_by_hash(labelled: DataFrame, label: str, most: int) -> DataFrame:
    """Of rows (id, text_hash, size, a label) ``most`` and the first of each label, those of the smallest hash of the id: the same whatever the partitions."""
    rest = [c for c in labelled.columns if c != label]
    first = F.min(F.struct(F.xxhash64("id").alias("_h"), *rest)).alias("_r")
    firsts = labelled.groupBy(label).agg(first).select(label, *[F.col(f"_r.{c}") for c in rest]).select(labelled.columns)
    return labelled.orderBy(F.xxhash64("id"), "id").limit(most).union(firsts).distinct()


def within_bytes(few: DataFrame, label: str, most: int, each: bool) -> DataFrame:
    """Of a bounded sample (id, text_hash, size, label) the rows before which fewer than ``most`` bytes come, by hash, in their label or in ``each`` other, and the first of each label."""
    order = [F.xxhash64("id"), F.col("id"), F.col("text_hash")]
    own = Window.partitionBy(label).orderBy(*order)
    upto = (own if each else Window.partitionBy(F.lit(0)).orderBy(*order)).rowsBetween(Window.unboundedPreceding, -1)
    out = few.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).withColumn("place", F.row_number().over(own))
    return out.where((F.col("before") < most) | (F.col("place") == 1)).drop("before")


def texts_of(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(the columns of ``keys``, text): a text of each row of a small saved table of (``id``, text_hash, ...)."""
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return own.join(hinted(keys), ["id", "text_hash"]).dropDuplicates(keys.columns).select(*keys.columns, "text")


def size_of(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("size")
