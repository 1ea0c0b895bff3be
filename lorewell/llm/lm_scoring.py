"""Language-model scores by stupid backoff, from n-gram counts of the whole corpus.

The counts are partitioned by hash (:mod:`lorewell.llm.counts`) and joined back to the n-grams
of each batch of documents, whose scores are summed per document.  A document's own
occurrences are taken off, so that it is scored by what the others say.

:func:`score_relational` says the same with a row for each n-gram: exploded n-grams, a count
table, joins and sums.  :func:`score_language_model` joins in batches, whose n-grams travel as
sorted, compressed keys, a few bytes each instead of a row; tests hold the two against each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import counts, spans
from lorewell.llm.graph import saved

ORDER, BACKOFF = 3, 0.4
_U = np.uint64


def _sizes(batches):
    for batch in batches:
        for _, _, raw, at in spans.passes(batch.column(0)):
            starts, _, _ = spans.words(raw, at)
            yield pa.RecordBatch.from_arrays([pa.array([len(raw)], pa.int64()), pa.array([len(starts)], pa.int64())], names=["n_bytes", "n_words"])


def _grams(column: pa.Array, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, documents) of the n-grams of each order from 1, of a whole column."""
    parts: list[list] = [[] for _ in range(order)]
    for first, _, raw, at in spans.passes(column):
        h, doc = spans.word_hashes(raw, at)
        for n in range(1, order + 1):
            g, where = spans.ngrams(h, doc, n, short=False)
            parts[n - 1].append((spans.mix(g + _U(n)), where + first))
    none = [(np.zeros(0, _U), np.zeros(0, np.int64))]
    return [tuple(np.concatenate(x) for x in zip(*(p or none), strict=True)) for p in parts]


def _others(total: np.ndarray, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each n-gram of a document, its count in the other documents."""
    width = int(ids.max()) + 1 if len(ids) else 1
    _, back, own = np.unique(doc * width + ids, return_inverse=True, return_counts=True)
    return total[ids] - own[back]


def score_language_model(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (``id_col``, n_words, n_order_1 .. n_order_N, n_unseen, log_score, mean_log_score).

    A word is scored by the longest n-gram that other documents hold too, relative to its
    context there, times ``backoff`` for each order given up; the first words of a text have
    shorter contexts at no cost.  A word in no other document scores as half an occurrence
    below order 1.  n_order_K counts the words scored at order K, and log_score sums natural
    logarithms.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Cases: a null text or one
    without words has log_score 0 and no mean; a very long text is in one batch, in memory that
    grows with it; each row is a document, so that a repeated row supports its twin; there are no
    ties; a null id passes through; an empty table gives no row; further columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    size = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_sizes, "n_bytes long, n_words long").agg(F.sum("n_bytes").alias("b"), F.sum("n_words").alias("w")).first()
    total = size["w"] or 0
    batches, bits = counts.plan(spark, size["b"] or 0, order * total)
    rows = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(batches)).alias("b"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([g for g, _ in _grams(table["text"], order)])
        return keys, np.ones(len(keys), np.int64)

    answers = counts.shared_counts(rows, keys_of, bits)

    def score(table: pa.Table, found: pa.Table) -> pa.Table:
        grams = _grams(table["text"], order)
        keys, _, where = counts.cut(np.concatenate([g for g, _ in grams]), np.ones(sum(len(g) for g, _ in grams), np.int64), bits)
        all_counts, n = counts.totals(found, keys, bits), table.num_rows
        ids = np.split(where, np.cumsum([len(g) for g, _ in grams])[:-1])
        others = [_others(all_counts, i, d) for i, (_, d) in zip(ids, grams, strict=True)]
        doc = grams[0][1]
        words = np.bincount(doc, minlength=n)
        place = np.arange(len(doc)) - np.r_[0, np.cumsum(words)][doc]
        level, value = np.zeros(len(doc), np.int64), np.zeros(len(doc))
        rest = np.maximum(1, total - words)[doc]
        for k in range(order, 0, -1):
            # Words whose n-gram of k words ends at them, in order.
            at = np.flatnonzero(place >= k - 1)
            if k == 1:
                below = rest
            else:
                # The context of the n-gram that begins at each place is the (k - 1)-gram that begins there.
                begins = place + k - 1 < words[doc]
                context = np.zeros(len(doc), np.int64)
                context[place + k - 2 < words[doc]] = others[k - 2]
                below = np.ones(len(doc), np.int64)
                below[at] = np.maximum(1, context[begins])
            here = np.zeros(len(doc), np.int64)
            here[at] = others[k - 1]
            on = (level == 0) & (here > 0)
            level[on] = k
            value[on] = np.log(here[on] / below[on])
        unseen = level == 0
        value[unseen] = np.log(0.5 / rest[unseen])
        given_up = np.minimum(order, place + 1) - np.maximum(level, 1) + unseen
        value += given_up * math.log(backoff)
        sums = np.bincount(doc, value, n).astype(np.float64)
        mean = [s / w if w else None for s, w in zip(sums.tolist(), words.tolist(), strict=True)]
        levels = [np.bincount(doc, level == k, n).astype(np.int64) for k in (*range(1, order + 1), 0)]
        return pa.table([table["id"], pa.array(words.astype(np.int64)), *[pa.array(x) for x in levels], pa.array(sums), pa.array(mean, pa.float64())], names=names)

    names = ["id", "n_words", *[f"n_order_{k}" for k in range(1, order + 1)], "n_unseen", "log_score", "mean_log_score"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *[f"{k} long" for k in names[1:-2]], "log_score double", "mean_log_score double"])
    return rows.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(score, schema).withColumnRenamed("id", id_col)


def score_relational(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of :func:`score_language_model` by tables of rows.

    Each n-gram is a row (doc, pos, n, h) with its context, and the count table (h) is their
    sum by document and then by hash, so that a frequent n-gram sends a row a task.  Hashes
    of 64 bits stand for n-grams.  Every n-gram of every document is shuffled three times: as a
    count, to the counts, and back to its place.
    """
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, "[ \\x09-\\x0D]+"), lambda w: w != "")
    rows = saved(docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), words.alias("w")))
    at = rows.select("doc", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "word")).where("word is not null")
    hashed = lambda n, last: F.xxhash64(F.lit(n), *[F.get("w", last - k) for k in range(n - 1, -1, -1)])
    pos = F.col("pos")
    gram = [F.when(pos >= n - 1, hashed(n, pos)).alias(f"g{n}") for n in range(1, order + 1)]
    context = [F.when(pos >= n - 1, hashed(n - 1, pos - 1)).alias(f"c{n}") for n in range(2, order + 1)]
    places = at.select("doc", "n_words", "pos", *gram, *context)
    each = F.explode(F.array(*[F.col(f"g{n}") for n in range(1, order + 1)])).alias("h")
    own = places.select("doc", each).where("h is not null").groupBy("doc", "h").agg(F.count("*").alias("own"))
    totals = own.groupBy("h").agg(F.sum("own").alias("total"))
    others = saved(own.join(totals, "h").select("doc", "h", (F.col("total") - F.col("own")).alias("others")).where("others > 0"))
    found = places
    for name in [*[f"g{n}" for n in range(1, order + 1)], *[f"c{n}" for n in range(2, order + 1)]]:
        found = found.join(others.select("doc", F.col("h").alias(name), F.col("others").alias(f"n_{name}")), ["doc", name], "left")
    every = rows.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("words"))
    scored = found.crossJoin(F.broadcast(every)).withColumn("rest", F.greatest(F.lit(1), F.col("words") - F.col("n_words")))
    level, value = F.lit(0), F.log(F.lit(0.5) / F.col("rest"))
    for n in range(1, order + 1):
        below = F.col("rest") if n == 1 else F.greatest(F.lit(1), F.coalesce(f"n_c{n}", F.lit(1)))
        seen = F.col(f"n_g{n}").isNotNull()
        level, value = F.when(seen, F.lit(n)).otherwise(level), F.when(seen, F.log(F.col(f"n_g{n}") / below)).otherwise(value)
    scored = scored.withColumn("level", level).withColumn("value", value)
    given_up = F.least(F.lit(order), F.col("pos") + 1) - F.greatest(F.col("level"), F.lit(1)) + (F.col("level") == 0).cast("int")
    counts_ = [F.count_if(F.col("level") == n).alias(f"n_order_{n}") for n in range(1, order + 1)]
    sums = scored.groupBy("doc").agg(*counts_, F.count_if(F.col("level") == 0).alias("n_unseen"), F.sum(F.col("value") + given_up * math.log(backoff)).alias("log_score"))
    both = rows.select("doc", "id", F.size("w").cast("long").alias("n_words")).join(sums, "doc", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    names = [f"n_order_{n}" for n in range(1, order + 1)] + ["n_unseen"]
    return both.select(F.col("id").alias(id_col), "n_words", *map(zero, names), F.coalesce("log_score", F.lit(0.0)).alias("log_score"), (F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
