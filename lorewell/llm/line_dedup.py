"""Line deduplication with DataFrame functions only.

A line's key is the line without white space at both ends and with A-Z lower-cased.
Keys are hashed with a salt of their document, and the hashes are dealt by range.  They are
uniform, so that the bounds of the ranges are computed, not sampled.  Within a range, keys
are sorted by document and position and streamed: the first document of each key goes on to
a second stream over the key alone, which has a row per range at most; all others lose the
line.  A line of a third of all documents is so dealt over as many tasks as the cluster has
partitions.
What returns is not text but a bitmap per document: the 64-bit words of dropped
positions, without the words that have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.graph import fresh

SPACE = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEWLINE = "\n"


def line_key(line: Column) -> Column:
    """The key that equal lines share."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), NEWLINE, -1)


def line_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_dropped, words): the positions that each document loses.

    A key of ``min_chars`` code points at least loses its lines in all documents but the
    smallest id that holds it; repeated lines of that document stay.  ``words`` maps
    position div 64 to a word of dropped bits.  Documents that lose nothing have no row.
    A null id neither drops lines nor makes others drop theirs.
    """
    spark = docs.sparkSession
    ranges = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    keys = rows.select("id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    # Two hashes of 64 bits: among 10^12 different lines, the chance of any clash is below 10^-14.
    hashed = keys.select("id", "text_hash", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))
    salted = F.xxhash64("h", F.pmod(F.xxhash64("id"), F.lit(ranges)))
    place = ((salted / F.lit(2.0**64) + 0.5) * ranges).cast("int")
    dealt = hashed.withColumn("range", F.least(place, F.lit(ranges - 1))).repartitionById(ranges, "range")
    first = dealt.withColumn("owner", F.first("id").over(Window.partitionBy("h", "g", "range").orderBy("id", "pos")))
    again = first.where(F.col("id") == F.col("owner")).select("id", "text_hash", "pos", "h", "g")
    final = again.withColumn("owner", F.first("id").over(Window.partitionBy("h", "g").orderBy("id", "pos")))
    dropped = first.where(F.col("id") != F.col("owner")).select("id", "text_hash", "pos").unionByName(final.where(F.col("id") != F.col("owner")).select("id", "text_hash", "pos"))
    bits = dropped.repartition("id", "text_hash").groupBy("id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("bits"))
    maps = bits.groupBy("id", "text_hash").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return maps.withColumnRenamed("id", id_col)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` without the repeated lines, and n_lines and n_dropped beside it.

    Lines are split at \\n; those that stay are joined by \\n, in order.  Cases: a null or
    empty text is one empty line (and becomes the empty text); a very long text costs a row of
    hashes a line; rows of one id count as one document, so that they drop no lines of each
    other; a null id keeps its text; an empty table stays empty; further columns pass through,
    whatever their names (n_lines and n_dropped are replaced).
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    its_id, its_hash, lost, words, own, lines, bits = fresh(docs.columns, "its_id", "its_hash", "lost", "words", "own", "lines", "bits")
    maps = line_bitmaps(docs, min_chars, id_col, text_col).select(F.col(id_col).alias(its_id), F.col("text_hash").alias(its_hash), F.col("n_dropped").alias(lost), F.col("words").alias(words))
    both = docs.select(*keep, F.xxhash64(text_col).alias(own)).join(maps.hint("shuffle_hash"), (F.col(id_col) == F.col(its_id)) & (F.col(own) == F.col(its_hash)), "left")
    top = F.array_max(F.map_keys(words))
    dense = F.transform(F.sequence(F.lit(0), top), lambda w: F.coalesce(F.try_element_at(F.col(words), w), F.lit(0).cast("long")))
    whole = F.coalesce(F.col(text_col), F.lit(""))
    held = both.withColumn(lines, _lines(F.col(text_col))).withColumn(bits, F.when(F.col(lost).isNotNull(), dense))
    kept = F.expr(f"array_join(filter({lines}, (x, i) -> (shiftrightunsigned(coalesce(get({bits}, cast(i div 64 as int)), 0L), cast(i % 64 as int)) & 1L) = 0L), '\\n')")
    out = {text_col: F.when(F.col(lost).isNull(), whole).otherwise(kept)}
    return held.select(*[out.get(c, F.col(c)).alias(c) for c in keep], F.size(lines).cast("long").alias("n_lines"), F.coalesce(lost, F.lit(0).cast("long")).alias("n_dropped"))
