"""Exact and near duplicates of texts."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.session import saved

#: Words of a shingle, permutations of a signature, bands of it.
SHINGLE, PERMS, BANDS = 5, 32, 8
_MASK = (1 << 61) - 1


def exact_owners(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, owner, is_dupe): the smallest id of equal texts owns them.

    Texts are hashed once and the hashes are kept.  Two aggregates instead of a window: the
    partial minimum leaves a row a task of a text that fills the corpus.
    """
    rows = saved(chunks.select(F.col(id_col).alias("id"), T.text_hash(F.col(text_col)).alias("text_hash")))
    owners = rows.groupBy("text_hash").agg(F.min("id").alias("owner"))
    return rows.join(owners, "text_hash").select(F.col("id").alias(id_col), "text_hash", "owner", (F.col("id") != F.col("owner")).alias("is_dupe"))


def record_dupes(known: DataFrame, found: DataFrame) -> DataFrame:
    """Keyed merge of (chunk_id, owner_id, kind, similarity): the found row of a chunk replaces the known one."""
    return found.unionByName(known.join(found.select("chunk_id"), "chunk_id", "left_anti"))


def dupe_stats(dupes: DataFrame) -> DataFrame:
    return dupes.groupBy("kind").agg(F.count("*").alias("n"))


def with_shingles(frame: DataFrame, text_col: str = "text", name: str = "shingles", k: int = SHINGLE) -> DataFrame:
    """Adds the distinct word k-grams of the comparable form; up to k words are one.  Texts without words are left out.

    The words are a column of their own and the filter is on them, so that no lambda makes
    them anew for each gram.
    """
    words = F.filter(F.split(T.norm(F.col(text_col)), " "), lambda w: w != "")
    rows = frame.withColumn("_words", words).where(F.size("_words") > 0)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("_words", i, k), " "))
    return rows.withColumn(name, F.array_distinct(grams)).drop("_words")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big")


def signature(grams) -> list[int]:
    """Minima of PERMS permutations of the shingles' hashes, modulo 2^61."""
    return minima(np.array([hash64(g) for g in grams], np.uint64)) if len(grams) else []


def minima(x: np.ndarray) -> list[int]:
    out = []
    for i in range(PERMS):
        a, b = (i * 0x9E3779B97F4A7C15) | 1, (i * 0xC2B2AE3D27D4EB4F) | 1
        # Wrapping at 2^64 keeps the low 61 bits exact.
        out.append(int(((x * np.uint64(a & 0xFFFFFFFFFFFFFFFF) + np.uint64(b & 0xFFFFFFFFFFFFFFFF)) & np.uint64(_MASK)).min()))
    return out


def band_keys(sig: list[int], bands: int = BANDS) -> list[str]:
    rows = max(1, len(sig) // bands)
    return [f"{b}:{hash64(','.join(map(str, sig[b * rows : (b + 1) * rows])))}" for b in range(bands)] if sig else []


def distinct_texts(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_hash, id, t): the comparable form of each text once, with the smallest id that has it; empty ones are left out.

    Copies meet in each task first, so that a text that fills the corpus sends a row a task.
    """
    rows = chunks.select(F.col(id_col).alias("id"), T.norm(F.col(text_col)).alias("t"))
    hashed = rows.select("id", "t", T.short_hash(F.col("t")).alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.min("id").alias("id"), F.min_by("t", "id").alias("t")).where("t <> ''")


def shingle_rows(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(text_hash, id, h): the hashes of the distinct word k-grams of (text_hash, id, t); up to k words are one.

    Words are exploded by place and grams are read from their array in the same generated code;
    texts are dealt by their hash already, so that their grams need not move.
    """
    words = texts.select("text_hash", "id", F.split("t", " ").alias("w"))
    at = words.select("text_hash", "id", "w", F.posexplode_outer("w").alias("pos", "x"))
    gram = F.xxhash64(*[F.get("w", F.col("pos") + i) for i in range(k)])
    return at.where((F.col("pos") == 0) | (F.col("pos") + k <= F.size("w"))).select("text_hash", "id", gram.alias("h")).distinct()


def _near_sets(chunks: DataFrame, least: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Shared shingles of each text (id, n, s), rarest first, and the index (id, n, k) of those by which texts meet.

    Two sets that reach the threshold share one of the rarest shingles of both: those up to so many that the others
    could not reach it.  Shingles of one text alone count among them, but lead nowhere.
    """
    grams = saved(shingle_rows(distinct_texts(chunks, id_col, text_col)).select("id", "h"))
    often = grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = grams.join(often, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    sets = grams.groupBy("id").agg(F.count("*").alias("n")).join(shared, "id")
    need = F.col("n") - F.ceil(F.col("n") * least) + 1 - (F.col("n") - F.size("s"))
    sets = saved(sets.select("id", "n", F.col("s.h").alias("s"), need.cast("int").alias("need"))).where("need > 0")
    return sets, sets.select("id", "n", F.explode(F.slice("s", F.lit(1), F.col("need"))).alias("k"))


def _met(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(first, later): texts of two indices with a key in common, of sizes that can reach the threshold."""
    sized = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least
    return a.alias("a").join(b.alias("b"), "k").where((F.col("a.id") < F.col("b.id")) & sized).select(F.col("a.id").alias("first"), F.col("b.id").alias("later")).distinct()


def _near(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    side = lambda end: sets.select(F.col("id").alias(end), F.col("s").alias(f"s_{end}"), F.col("n").alias(f"n_{end}"))
    both = pairs.join(side("first"), "first").join(side("later"), "later").withColumn("c", F.size(F.array_intersect("s_first", "s_later")))
    return both.select("first", "later", F.round(F.col("c") / (F.col("n_first") + F.col("n_later") - F.col("c")), 4).alias("similarity")).where(F.col("similarity") >= threshold)


def _copies(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    owners = exact_owners(chunks, id_col, text_col).where("is_dupe")
    return owners.where(F.col("text_hash") != T.text_hash(F.lit(""))).select(F.col("owner").alias("first"), F.col(id_col).alias("later"), F.lit(1.0).alias("similarity"))


def near_pairs(chunks: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(first, later, similarity) of all pairs that reach the threshold, to four digits.

    Equal texts are paired through their first id alone, so that a large group of copies makes
    a row each instead of all pairs; only first ids are compared.  Pairs are what this yields, all of them;
    ``near_owners`` has a row a text.
    """
    sets, index = _near_sets(chunks, threshold - 1e-4, id_col, text_col)
    return _near(_met(index, index, threshold - 1e-4), sets, threshold).unionByName(_copies(chunks, id_col, text_col))


#: Members of a key that a text meets in the first round, and how many times as many in each one after it.
FIRST_MEMBERS, MORE_MEMBERS = 8, 8


def near_owners(chunks: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(first, later, similarity): the smallest id whose text reaches the threshold, for each text that has an earlier one.

    Equal to the first of each text's ``near_pairs``, without them.  Members of a key are ranked by id, and texts
    meet the first few of each of their keys.  A text is done when its keys hold no unmet id below the
    smallest partner that it found; the others meet further members, of which there are eight times as many a round.
    Near copies of one text meet it in the first round, so that a group of n makes rows in proportion to n; many
    rounds are left to texts that share their rarest shingles with many that they are no copies of.
    """
    least = threshold - 1e-4
    sets, index = _near_sets(chunks, least, id_col, text_col)
    ranked = saved(index.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("id"))))
    undone, found, low, high = ranked.select("id").distinct(), None, 0, FIRST_MEMBERS
    out: list[DataFrame] = []
    while True:
        asked = ranked.join(undone, "id", "left_semi")
        near = _near(_met(ranked.where((F.col("r") > low) & (F.col("r") <= high)), asked, least), sets, threshold)
        near = near if found is None else near.unionByName(found)
        best = near.groupBy("later").agg(F.min(F.struct("first", "similarity")).alias("m")).select("later", "m.first", "m.similarity")
        unmet = ranked.where(F.col("r") == high + 1).select("k", F.col("id").alias("cut"))
        ahead = asked.join(unmet, "k").where("cut < id").groupBy("id").agg(F.min("cut").alias("cut"))
        state = saved(undone.join(best.withColumnRenamed("later", "id"), "id", "left").join(ahead, "id", "left").withColumn("open", F.col("cut").isNotNull() & (F.col("first").isNull() | (F.col("cut") < F.col("first")))))
        rows = state.select("first", F.col("id").alias("later"), "similarity", "open").where("first is not null")
        out.append(rows.where("not open").drop("open"))
        undone, found = state.where("open").select("id"), rows.where("open").drop("open")
        if undone.isEmpty():
            break
        low, high = high, high * MORE_MEMBERS
    return reduce(DataFrame.unionByName, [*out, _copies(chunks, id_col, text_col)])


def near_marks(pairs: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """One owner a later chunk, the first of them; chunks that are marked already are left out."""
    one = pairs.withColumn("n", F.row_number().over(Window.partitionBy("later").orderBy("first"))).where("n = 1").drop("n")
    return one if marked is None else one.join(marked.select(F.col("chunk_id").alias("later")), "later", "left_anti")
