import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from lorewell.llm import sampling, spans
from lorewell.llm.language_id import FOLD, TEMPERATURE, _training_texts, identify_language, train

from . import fixtures


def brute_bits(training, text, order=4):
    fold = lambda t: bytes(FOLD[np.frombuffer(t.encode(), np.uint8)])
    tree = defaultdict(Counter)
    for t in training:
        b = b" " * order + fold(t)
        for i in range(order, len(b)):
            for n in range(order + 1):
                tree[b[i - n : i]][b[i]] += 1
    b, bits = b" " * order + fold(text), 0.0
    for i in range(order, len(b)):
        for n in range(order, -1, -1):
            seen = tree.get(b[i - n : i])
            if seen and seen[b[i]]:
                bits -= math.log2(seen[b[i]] / (sum(seen.values()) + len(seen)))
                break
            if seen:
                bits -= math.log2(len(seen) / (sum(seen.values()) + len(seen)))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    texts = {"a": ["the cat sat on the mat", "A dog, 12 cats"], "b": ["le chat est là", "où est le chien?"], "c": [""]}
    model = train(texts)
    samples = ["the dog", "là où", "zz 99 ÿ", "", "chat\n\tchien the the"]
    raw, at = spans.column_bytes(pa.array(samples))
    got = model.bits(raw, at)
    for i, s in enumerate(samples):
        for j, k in enumerate(model.languages):
            assert abs(got[i, j] - brute_bits(texts[k], s)) < 1e-3


def test_held_out_accuracy_and_inputs(spark):
    docs = spark.read.parquet(f"{fixtures.SMALL}/documents.parquet")
    out = identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and held
    assert sum(r.lang_pred == r.lang for r in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_predictions_equal_brute_force(spark):
    """The query's whole answer from context trees in plain Python over all rows that it may learn from."""
    rows = [(d, t if t is None else t[:400], k) for d, t, k, *_ in fixtures.rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = identify_language(docs.withColumn("row", F.monotonically_increasing_id()), id_col="row").collect()
    table = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "text", "lang", sampling.held_out("row").alias("held")).collect()
    training = defaultdict(list)
    for r in table:
        if not r.held and r.lang is not None and r.text is not None:
            training[r.lang].append(r.text)
    found = {r.row: r for r in out}
    for r in table:
        got = found[r.row]
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        bits = {k: brute_bits(v, r.text) for k, v in training.items()}
        best = min(bits.values())
        assert bits[got.lang_pred] < best + 1e-2
        assert abs(got.score - 1 / sum(2 ** (-(b - best) / TEMPERATURE) for b in bits.values())) < 1e-3


def test_samples_are_bounded_by_language_and_in_all(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "cast(pmod(id, 40) AS string) AS lang")
    whole = _training_texts(docs, "doc_id", "text", "lang", 5)
    assert len(whole) == 40 and all(len(v) == 5 for v in whole.values())
    many = docs.selectExpr("doc_id", "text", "cast(doc_id AS string) AS lang").unionByName(docs.selectExpr("doc_id", "repeat('x', 200000) AS text", "'long' AS lang"))
    found = _training_texts(many, "doc_id", "text", "lang", 300)
    assert len(found) > 1000 and len(found["long"]) == 1 and all(len(v) == 1 for v in found.values())


def test_long_texts_alone_are_learnt_from(spark):
    docs = spark.createDataFrame([(i, ("the house and the garden " if i % 2 else "das Haus und der Garten ") * 5600, "en" if i % 2 else "de") for i in range(12)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") and r.score > 0.9 for r in identify_language(docs).collect())


def test_cases(spark):
    got = [(r.doc_id, r.lang_pred) for r in identify_language(fixtures.docs(spark)).collect()]
    texts = {r[0]: r[1] for r in fixtures.rows()}
    assert len(got) == len(fixtures.rows())
    for d, pred in got:
        t = texts.get(d)
        if d is not None:
            assert (pred == "und") == (t is None or not any(c.isalpha() for c in t))
    assert identify_language(fixtures.empty(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify_language(unlabelled).first().lang_pred == "und"
