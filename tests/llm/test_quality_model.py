import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorewell.llm import quality_model as Q
from lorewell.llm import sampling, spans
from lorewell.llm.quality_model import classify_quality

from . import fixtures


def plain_score(model, text):
    """A document's score in plain Python: its words' rows, their means, two layers, the temperature."""
    own_hash = lambda b: int(spans.hash_spans(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    kind = lambda c: ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c
    shapes = []
    for w in words:
        s = [kind(c) for c in w]
        shapes.append(bytes(c for i, c in enumerate(s) if not i or c != s[i - 1]))
    mean = lambda table, keys: [sum(float(table[own_hash(k) % len(table)][j]) for k in keys) / len(keys) if keys else 0.0 for j in range(Q.DIM)]
    again = sum(a == b for a, b in zip(low, low[1:], strict=False))
    x = [*mean(model.words, low), *mean(model.shapes, shapes), math.log1p(len(words)), again / max(1, len(words))]
    x = [(v - float(c)) / float(s) for v, c, s in zip(x, model.centre, model.scale, strict=True)]
    w1, b1, w2, b2 = (a.astype(float).tolist() for a in model.layers)
    hidden = [max(0.0, sum(v * w1[i][j] for i, v in enumerate(x)) + b1[j]) for j in range(Q.HIDDEN)]
    z = (sum(h * w2[j][0] for j, h in enumerate(hidden)) + b2[0]) / model.temperature
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_equal_plain_python():
    texts = [t or "" for _, t, *_ in fixtures.rows()]
    model = Q.train(texts, np.array([i % 2 for i in range(len(texts))]))
    some = texts[:20] + ["", " \n ", "One two TWO two\n3,14!", "é É ß 12ab", "x"]
    got = model.score(*spans.column_bytes(pa.array(some, pa.string())))
    assert all(abs(a - plain_score(model, t)) < 1e-3 for a, t in zip(got, some, strict=True))


def test_query_learns_from_every_allowed_label_alone(spark):
    """The whole operator against a model trained here on the rows that it may learn from."""
    docs, labels = fixtures.docs(spark), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = docs.select("doc_id", "text", sampling.held_out().alias("held")).collect()
    known = sorted((r.text or "", r.doc_id % 2) for r in rows if r.doc_id is not None and r.doc_id < 60 and not r.held)
    model = Q.train([t for t, _ in known], np.array([y for _, y in known]))
    got = {(r.doc_id, r.held_out): r.score for r in classify_quality(docs, labels).where("doc_id < 60").collect()}
    for r in rows:
        if r.doc_id is not None and r.doc_id < 60:
            assert abs(got[r.doc_id, r.held] - plain_score(model, r.text or "")) < 0.02


def test_long_and_repeated_training_rows(spark):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(20)] + [(2, "another text")] * 50 + [(3, "y " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    out = classify_quality(docs, labels)
    assert out.count() == 71 and out.where("score is null").count() == 0


def test_long_texts_alone_are_learnt_from(spark):
    """Whatever the length of the texts, and however many labels are for documents that don't exist."""
    docs = spark.createDataFrame([(i, ("good clean words here " if i % 2 else "### $$ junk 123 ") * 7000) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int").union(spark.range(1000, 101_000).selectExpr("id", "1"))
    out = {r.doc_id: r.score for r in classify_quality(docs, labels).collect()}
    assert min(out[i] for i in range(1, 12, 2)) > max(out[i] for i in range(0, 12, 2)) + 0.2


def test_sample_ends_at_its_bytes_with_one_of_each_label(spark):
    rows = spark.createDataFrame([(i, i, 100, int(i < 95)) for i in range(100)] + [(200, 1, 10**9, 2)], "id long, text_hash long, size long, label int")
    few = sampling.within_bytes(rows.where("label < 2"), "label", 1000, each=False).collect()
    assert 10 <= len(few) <= 11 and {r.label for r in few} == {0, 1}
    assert {r.label for r in sampling.within_bytes(rows, "label", 300, each=True).collect()} == {0, 1, 2}
    assert {r.label for r in sampling.sample_by_hash(rows, "label", 3).collect()} == {0, 1, 2}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = classify_quality(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert out.count() == docs.count()
    right = sum(r.predicted == r.quality for r in rows)
    brier = sum((r.score - r.quality) ** 2 for r in rows) / len(rows)
    assert right >= 0.95 * len(rows) and brier < 0.05
    assert {r.quality for r in rows} == {0, 1}


def test_cases(spark):
    docs = fixtures.docs(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    out = classify_quality(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.score for r in classify_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in classify_quality(docs, labels.where("quality = 1")).collect()} == {1}
    assert classify_quality(fixtures.empty(spark), labels).count() == 0


def test_same_result_whatever_the_partitions(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    runs = [sorted(((r.doc_id, r.score) for r in classify_quality(fixtures.docs(spark, parts=p), labels).collect()), key=str) for p in (1, 6)]
    assert runs[0] == runs[1]
