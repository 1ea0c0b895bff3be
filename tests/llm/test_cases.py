"""Cases that all operators define: further columns of any name, a text of several MB, one table of nulls."""

import random

import pytest
from pyspark.sql import functions as F

from lorewell.llm import queries
from lorewell.llm.decontaminate import drop_contaminated, mark_contaminated
from lorewell.llm.jaccard_join import shingle_components
from lorewell.llm.language_id import identify_language
from lorewell.llm.line_dedup import drop_repeated_lines
from lorewell.llm.lm_scoring import score_language_model
from lorewell.llm.packing import pack_documents
from lorewell.llm.pii import find_pii
from lorewell.llm.quality_model import classify_quality
from lorewell.llm.quality_rules import keep_clean, quality_report

from . import fixtures

pytest.importorskip("public_tokenizers")
ITEM = "the quick brown fox jumps over the lazy dog while a cat looks on from under the old wooden table by the door"


def operators(spark):
    bench = spark.createDataFrame([(1, ITEM, "x"), (2, "café café café", "y")], "item_id long, text string, doc string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    return {
        "join": shingle_components,
        "quality": lambda d: classify_quality(d, labels),
        "scores": lambda d: score_language_model(d).withColumn("log_score", F.round("log_score", 6)).withColumn("mean_log_score", F.round("mean_log_score", 6)),
        "lines": lambda d: drop_repeated_lines(d).select("doc_id", "text", "n_dropped"),
        "packing": lambda d: pack_documents(d, queries.vocabulary_path()).groupBy("doc_id").agg(F.sum("length"), F.sum("loss_tokens")),
        "language": identify_language,
        "marks": lambda d: mark_contaminated(d, bench, short_items=True),
        "clean": lambda d: drop_contaminated(d, bench, short_items=True).select("doc_id", "text"),
        "rules": quality_report,
        "kept": lambda d: keep_clean(d).select("doc_id", "text"),
        "pii": find_pii,
    }


NAMES = ["join", "quality", "scores", "lines", "packing", "language", "marks", "clean", "rules", "kept", "pii"]
CLASHES = ["id", "_id", "ID_", "text_hash", "_hash", "item", "items", "b", "h", "doc", "key", "label", "found_id", "found_hash", "its_id", "its_hash", "lost", "words", "own", "lines", "_lines", "_bits", "bits", "pos", "range", "component", "held_out", "score", "place", "prompt"]


def rows_of(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_further_columns_change_nothing(spark, name):
    run = operators(spark)[name]
    docs = spark.createDataFrame(fixtures.rows()[:50] + [(900, ITEM + " and more", "en", "s", 1), (901, "So: " + ITEM, "en", "s", 1)], fixtures.DOCS).coalesce(1)
    more = docs.select("*", *[F.lit(f"v{i}").alias(c) for i, c in enumerate(CLASHES)])
    assert rows_of(run(more)) == rows_of(run(docs))


def test_rows_keep_further_columns(spark):
    docs = fixtures.docs(spark).select("*", *[F.lit(f"v{i}").alias(c) for i, c in enumerate(CLASHES)]).withColumn("n_chars", F.lit("many"))
    for frame in (drop_repeated_lines(docs).drop("n_lines", "n_dropped"), keep_clean(docs), operators(spark)["clean"] and drop_contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))):
        assert frame.columns == docs.columns
        row = frame.first()
        assert [row[c] for c in CLASHES] == [f"v{i}" for i in range(len(CLASHES))] and row["n_chars"] == "many"


def long_rows():
    rng = random.Random(5)
    line = lambda n: " ".join(fixtures.words(rng, n)) + "."
    long = "\n".join(line(40) for _ in range(9000))  # about 2 MB
    return [(1, long, "en", "s", 1), (2, long + "\n" + ITEM, "en", "s", 1), (3, line(300_000), "fr", "s", 1), (4, "x" * 2_000_000, "en", "s", 1), (5, line(50), "fr", "s", 1), (6, None, None, None, None), (7, "", "en", "s", 0)]


@pytest.mark.parametrize("name", NAMES)
def test_very_long_texts(spark, name):
    docs = spark.createDataFrame(long_rows(), fixtures.DOCS)
    out = {r.doc_id: r for r in operators(spark)[name](docs).collect()}
    ids = {1, 2, 3, 4, 5, 6, 7}
    if name == "join":
        assert {d: r.component_id for d, r in out.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    elif name == "lines":
        assert out[2].text == ITEM and out[2].n_dropped == 9000 and out[4].n_dropped == 0
    elif name == "marks":
        assert {d for d, r in out.items() if r.contaminated} == {2}
    elif name == "clean":
        assert set(out) == ids - {2}
    elif name == "scores":
        assert out[3].n_words == 300_000 and out[1].n_order_3 == out[1].n_words - 2
    else:
        assert set(out) <= ids and (name == "kept" or set(out) == ids)


def test_null_rows_alone(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, None, None, None, None)], fixtures.DOCS)
    for name, run in operators(spark).items():
        assert run(docs).count() == {"kept": 0, "packing": 2}.get(name, 3), name
