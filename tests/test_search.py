"""Search against plain Python: stems, BM25 over them, vectors in blocks, near pairs."""

import math
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lorewell.functions.stemming import porter, unmarked
from lorewell.operators import dedupe, graph, library, search
from lorewell.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_stems_of_known_words():
    # Word and stem, as the algorithm's paper has them.
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit differentli differ vietnamization vietnam operator oper hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic formative form electrical electr goodness good revival reviv allowance allow inference infer adjustable adjust replacement replac adjustment adjust dependent depend adoption adopt effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    assert [(w, porter(w)) for w in pairs[::2]] == list(zip(pairs[::2], pairs[1::2], strict=True))
    assert [porter(w) for w in ("", "a", "is", "été")] == ["", "a", "is", "été"]


def test_letters_without_marks(spark):
    row = spark.createDataFrame([("ÀÉîõü ñ ß ø ž Ǻ x",)], "t string").select(unmarked(F.lower("t"))).first()[0]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    assert row == plain("àéîõü ñ ß ø ž ǻ x")


def test_stemmed_search_equals_plain_python(spark):
    words = lambda t: [porter(w) for w in re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if unicodedata.category(c) != "Mn"))]
    docs = {r.doc_id: (words(r.text), words(r.source)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    asked = {r.item_id: list(dict.fromkeys(words(r.text)))[:64] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    size = {d: len(a) + len(b) for d, (a, b) in docs.items()}
    n, mean = sum(s > 0 for s in size.values()), sum(size.values()) / sum(s > 0 for s in size.values())
    weights = {d: Counter(a) + Counter({w: 4 * c for w, c in Counter(b).items()}) for d, (a, b) in docs.items()}
    df = Counter(w for c in weights.values() for w in c)
    want = {}
    for q, terms in asked.items():
        score = Counter()
        for w in terms:
            idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5))
            for d, c in weights.items():
                if w in c:
                    score[d] += (idf if idf > 0 else 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[d] / mean))
        want[q] = [d for d, _ in sorted(((d, round(s, 9)) for d, s in score.items()), key=lambda x: (-x[1], x[0]))[:10]]
    got = {}
    for r in catalog.queries()["stemmed_top10"](spark, SMALL).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


def test_stems_that_are_asked_for_alone_make_rows(spark):
    """The size counts every document with a word, and chunks of one id are added up by the search."""
    rows = [(1, "Running runs; ran", "the run"), (2, "cats", None), (3, None, ""), (4, " .. ", "x"), (5, "the CAT runs a cat", "run")]
    docs = spark.createDataFrame(rows, "id long, text string, title string").repartition(3)
    asked = spark.createDataFrame([(7, "runner running"), (8, "a cat")], "query_id long, query string")
    columns = {"text": 1.0, "title": 4.0}
    index, size = search.stem_postings(docs, columns, asked, "id")
    full = search.postings(docs, columns, "id", stems=True)
    terms = ["runner", "run", "a", "cat"]
    read = lambda frame: sorted(tuple(r) for r in frame.select("id", "len", "term", "wtf", "tf").collect())
    assert read(index) == read(full.where(F.col("term").isin(terms))) and len(read(index)) < len(read(full))
    assert size.first() == search.corpus_size(docs, columns, "id", stems=True).first()
    best = lambda frame, **more: sorted(tuple(r) for r in search.bm25(frame, asked, 3, size=size, stems=True, **more).collect())
    assert best(index, parts=True) == best(full) != []
    halves = index.withColumn("wtf", F.col("wtf") / 2)
    assert best(halves.unionAll(halves), parts=True) == best(full)


def test_documents_are_scored_in_blocks_where_their_words_are(spark, monkeypatch):
    """No row of a query and a document is shuffled but the best of each task; blocks of documents, words and queries change nothing."""
    rng = np.random.default_rng(2)
    rows = [(i, int(n), f"w{t}", float(1 + t % 3)) for i in range(300) for n in [rng.integers(1, 90)] for t in sorted(set(rng.integers(0, 40, 9).tolist()))]
    rows += [(1000 + i, n, t, w) for i, n, t, w in rows if i < 50]  # equal scores
    index = spark.createDataFrame(rows, "id long, len long, term string, wtf double").repartition(6)
    words = {q: [f"w{(q * 7 + j * j) % 45}" for j in range(6)] for q in range(11)}
    asked = spark.createDataFrame([(q, " ".join(w)) for q, w in words.items()], "query_id long, query string")
    sizes = {r[0]: r[1] for r in rows}
    n, mean = len(sizes), sum(sizes.values()) / len(sizes)
    df = Counter(r[2] for r in rows)
    want = set()
    for q, own in words.items():
        score = Counter()
        for i, length, t, w in rows:
            if t in own:
                idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
                score[i] += (idf if idf > 0 else 1e-6) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * length / mean))
        want |= {(q, i, round(s, 6), k) for k, (i, s) in enumerate(sorted(((d, round(s, 9)) for d, s in score.items()), key=lambda x: (-x[1], x[0]))[:5])}
    read = lambda frame: {(r.query_id, r.id, round(r.score, 6), r.rank) for r in frame.collect()}
    out = search.bm25(index, asked, 5)
    assert read(out) == want
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(search, "SCORE_CELLS", 20)
    assert read(search.bm25(index, asked, 5)) == want
    assert search.bm25(index, asked.limit(0), 5).count() == 0 == search.bm25(index.limit(0), asked, 5).count()


def test_vectors_in_blocks_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8)).round(1)
    x[500:] = x[:200]  # equal scores
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(9000, None)]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>").repartition(5)
    asked = vectors.where("id % 50 = 0 and vec is not null").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    best = lambda q, k, ids: [(i, round(float(x[i] @ x[q]), 9)) for i in sorted(ids, key=lambda i: (-round(float(x[i] @ x[q]), 9), i))[:k]]
    read = lambda frame: {q: [(r.id, r.score) for r in sorted((r for r in frame_rows if r.query_id == q), key=lambda r: r["rank"])] for frame_rows in [frame.collect()] for q in range(0, 700, 50)}
    want = {q: best(q, 7, range(700)) for q in range(0, 700, 50)}
    assert read(search.vector_search(vectors, asked, 7)) == want
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    assert read(search.vector_search(vectors, asked, 7)) == want
    odd = read(search.vector_search(vectors, asked, 7, F.col("id") % 2 == 1))
    assert odd == {q: best(q, 7, range(1, 700, 2)) for q in range(0, 700, 50)}
    assert search.vector_search(vectors, asked.limit(0), 3).count() == 0 == search.vector_search(vectors.limit(0), asked, 3).count()
    known = spark.createDataFrame([(0, i) for i in range(1, 40)], "a long, b long")
    pairs = graph.knn_pairs(vectors, asked.select(F.col("query_id").alias("id"), F.col("qvec").alias("vec")), 3, -99.0, known)
    got = sorted((r.b, r.similarity) for r in pairs.where("a = 0").collect())
    assert got == sorted(best(0, 3, [i for i in range(1, 700) if not 0 < i < 40]))
    assert library.nearest(vectors.where("id <> 0"), asked.where("query_id = 0")).first()["id"] == best(0, 1, range(1, 700))[0][0]


def test_top_k_stops_early_in_each_task(spark):
    frame = spark.range(1000).selectExpr("id", "id % 3 query_id", "cast(id as double) score").repartition(4)
    assert "WindowGroupLimit" in search.top_k(frame, 5)._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_are_complete(spark):
    """Every pair at the threshold, by brute force over all of a table's texts."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    norm = lambda t: " ".join(re.sub(r"\s+", " ", (t or "").translate(str.maketrans("‘’“”–— ", "''\"\"-- ", "­​‌‍‎‏﻿"))).split()).lower()
    first, sets = {}, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        t = norm(r.text)
        if t and first.setdefault(t, r.doc_id) == r.doc_id:
            w = t.split()
            sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for threshold in (0.8, 0.5):
        want = {(a, b) for a in sets for b in sets if a < b and round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 4) >= threshold}
        want |= {(first[t], r.doc_id) for r in rows if (t := norm(r.text)) and first[t] != r.doc_id}
        found = dedupe.near_pairs(spark.read.parquet(f"{SMALL}/documents.parquet"), threshold).collect()
        assert {(r["first"], r.later) for r in found} == want and len(found) == len(want)
