"""The chunk store: upserts, deletions, vectors that go with their texts, and searches."""

from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import evaluate, telemetry
from lorewell.sources.store import ChunkStore


def chunks(spark, rows):
    frame = spark.createDataFrame(rows, "path string, title string, text string, source_type string, at int")
    return frame.select(T.chunk_id(F.col("path"), F.lit(""), F.col("title")).alias("id"), "path", "title", F.lit("").alias("section"), "text", "source_type", T.est_tokens(F.col("text")).alias("tokens"), "at")


def test_round_trip(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=4)
    assert store.chunks().count() == 0
    store.add(chunks(spark, [(f"p{i}", f"t{i}", f"words about topic{i} and more", "web" if i % 2 else "pdf", 0) for i in range(30)]), "at", dim=16)
    assert store.chunks().count() == 30 == store.vectors().count()
    before = {r.id: r.vec for r in store.vectors().collect()}
    store.add(chunks(spark, [("p1", "t1", "old", "web", 1), ("p1", "t1", "zebras only", "web", 2), ("q", "new", "something", "web", 1)]).drop("x"), "at")
    texts = {r.path: r.text for r in store.chunks().collect()}
    assert len(texts) == 31 and texts["p1"] == "zebras only" and texts["p2"] == "words about topic2 and more"
    after = {r.id: r.vec for r in store.vectors().collect()}
    assert len(after) == 29 and all(before[k] == v for k, v in after.items())
    asked = spark.createDataFrame([(1, "zebras"), (2, "topic4"), (3, "topic5")], "query_id long, query string")
    found = {r.query_id: r.id for r in store.search_text(asked, 1).collect()}
    paths = {r.id: r.path for r in store.chunks().collect()}
    assert {q: paths[i] for q, i in found.items()} == {1: "p1", 2: "p4", 3: "p5"}
    assert {r.query_id for r in store.search_text(asked, 5, source_type="pdf").collect()} == {2}
    q = store.vectors().limit(1).select(F.lit(7).alias("query_id"), F.col("vec").alias("qvec"), "id")
    own = q.first()
    top = store.search_vector(q, 3).collect()
    assert top[0].score == 1.0 and own.id in {r.id for r in top if r.score == 1.0}
    store.delete(spark.createDataFrame([(f"p{i}",) for i in range(0, 30, 2)] + [("q",)], "path string"))
    left = {r.path for r in store.chunks().collect()}
    assert left == {f"p{i}" for i in range(1, 30, 2)} and store.vectors().count() == 14
    store.delete(spark.createDataFrame([(f"p{i}",) for i in range(30)], "path string"))
    assert store.chunks().count() == 0 == store.vectors().count()
    store.add(chunks(spark, [("z", "t", "again", "web", 0)]), "at")
    assert [r.path for r in store.chunks().collect()] == ["z"]


def test_audit_log_is_appended_and_its_tail_read(spark, tmp_path):
    path = str(tmp_path / "audit")
    for i in range(3):
        telemetry.append_log(spark.createDataFrame([(float(10 * i + k), f"e{i}{k}") for k in range(4)], "ts double, event_id string"), path)
    assert [r.event_id for r in telemetry.tail(telemetry.read_log(spark, path, "ts double, event_id string"), 5).collect()] == ["e23", "e22", "e21", "e20", "e13"]
    assert telemetry.read_log(spark, path, "ts double, event_id string").count() == 12


def test_gold_questions_and_tiers(spark):
    gold = spark.createDataFrame([("a", "in_graph", {"c": 3, "d": 1}), ("b", "in_graph", {"c": 1}), ("e", "out_of_graph", {"c": 3})], "id string, category string, judgments map<string,int>")
    got = {r.id: (r.relevant, r.answerable) for r in evaluate.gold_marks(gold).collect()}
    assert got == {"a": (["c"], True), "b": ([], False), "e": (["c"], False)}
    outcomes = spark.createDataFrame([(1,), (1,), (3,), (4,)], "tier int")
    assert {r.tier: (r.n, r.share) for r in evaluate.tier_histogram(outcomes).collect()} == {1: (2, 0.5), 2: (0, 0.0), 3: (1, 0.25), 4: (1, 0.25)}
