"""Versions of tables: whole reads, conflicts and crashes; an index that is kept and extended."""

import pytest
from pyspark.sql import functions as F

from lorewell.operators import search
from lorewell.sources import snapshots, textindex
from lorewell.sources.snapshots import Conflict, Snapshots
from lorewell.sources.store import ChunkStore
from lorewell.sources.textindex import TextIndex


def test_readers_see_whole_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert snapshots.publish(spark.range(10), folder, expected=10) == 10
    old = snapshots.published(spark, folder)
    assert snapshots.publish(spark.range(100, 120), folder) == 20
    assert old.count() == 10 and old.agg(F.max("id")).first()[0] == 9
    assert snapshots.published(spark, folder).count() == 20 and snapshots.published(spark, folder, 1).count() == 10
    with pytest.raises(ValueError, match="20 rows, not 7"):
        snapshots.publish(spark.range(20), folder, expected=7)
    assert snapshots.published(spark, folder).agg(F.min("id")).first()[0] == 100
    assert Snapshots(spark, folder).vacuum(keep=1) == 1 and Snapshots(spark, folder).versions() == [2]
    assert snapshots.published(spark, folder).count() == 20


def test_of_two_writers_one_gets_a_conflict(spark, tmp_path):
    a, b = (Snapshots(spark, str(tmp_path / "t")) for _ in range(2))
    base, _ = a.read()
    assert a.commit(base, {"rows": a.write(spark.range(1), "rows")}) == 1
    with pytest.raises(Conflict):
        b.commit(base, {"rows": b.write(spark.range(2), "rows")})
    assert b.read()[0] == 1 and b.commit(1, {"rows": "data/x"}) == 2
    assert not list((tmp_path / "t" / "_versions").glob(".*.tmp"))


def _chunk(i, text="words"):
    return (f"c{i}", f"p{i}", "t", "", text, "web", 1)


CHUNK = "id string, path string, title string, section string, text string, source_type string, tokens int"


def test_a_crash_at_any_step_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    store.add(spark.createDataFrame([_chunk(i) for i in range(20)], CHUNK), dim=8)
    both = lambda: (store.chunks().count(), store.vectors().count())
    assert both() == (20, 20)
    steps = [(ChunkStore, "_replaced"), (ChunkStore, "_touched"), (Snapshots, "commit")]
    for cls, name in steps:
        for after in (False, True) if name == "_replaced" else (False,):
            real = getattr(cls, name)

            def fail(*args, real=real, after=after):
                if after:
                    real(*args)
                raise RuntimeError("lost")

            with monkeypatch.context() as m:
                m.setattr(cls, name, fail)
                with pytest.raises(RuntimeError, match="lost"):
                    store.add(spark.createDataFrame([_chunk(1, "new"), _chunk(50)], CHUNK))
                assert both() == (20, 20)
    first = ChunkStore(spark, str(tmp_path / "s"), buckets=4, version=1)
    assert store.add(spark.createDataFrame([_chunk(1, "new"), _chunk(50)], CHUNK)) == 2
    assert both() == (21, 19) and first.chunks().count() == 20 == first.vectors().count()


def texts(spark, ids, word="w"):
    return spark.createDataFrame([(i, f"{word}{i} common " + f"shared{i % 3} " * (i % 4 + 1) + f"term{i % 17}", f"title{i % 2}") for i in ids], "id long, text string, title string")


COLUMNS = {"text": 1.0, "title": 4.0}


def same_as_rebuilt(spark, index, docs):
    asked = spark.createDataFrame([(1, "w5 shared1"), (2, "common title0"), (3, "term3 TERM4 v9"), (4, "nothing")], "query_id long, query string")
    read = lambda frame: sorted(map(tuple, frame.collect()))
    rebuilt = search.bm25(search.postings(docs, COLUMNS, "id"), asked, 7, size=search.corpus_size(docs, COLUMNS, "id"))
    assert read(index.search(asked, 7)) == read(rebuilt) != []
    assert tuple(index.size().first()) == pytest.approx(tuple(search.corpus_size(docs, COLUMNS, "id").first()))


def test_index_equals_a_rebuilt_one_after_adds_and_deletes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "MERGED", 3)
    index = TextIndex(spark, str(tmp_path / "i"), COLUMNS)
    assert index.search(spark.createDataFrame([(1, "x")], "query_id long, query string")).count() == 0
    index.add(texts(spark, range(40)))
    index.add(texts(spark, range(40, 60)))
    same_as_rebuilt(spark, index, texts(spark, range(60)))
    assert len(index.table.read()[1]["segments"]) == 2  # a batch is a segment
    index.add(texts(spark, range(5, 12), "v"))  # replaces seven, and makes three small segments one
    assert len(index.table.read()[1]["segments"]) == 1
    now = texts(spark, [i for i in range(60) if not 5 <= i < 12]).union(texts(spark, range(5, 12), "v"))
    same_as_rebuilt(spark, index, now)
    version = index.delete(texts(spark, range(0, 60, 7)))
    same_as_rebuilt(spark, index, now.where("id % 7 <> 0"))
    index.add(texts(spark, [7, 14]))
    later = now.where("id % 7 <> 0").union(texts(spark, [7, 14]))
    same_as_rebuilt(spark, index, later)
    index.optimise()
    assert index.table.read()[1]["tombstones"] == [] and len(index.table.read()[1]["segments"]) == 1
    same_as_rebuilt(spark, index, later)
    old = spark.createDataFrame([(1, "w14")], "query_id long, query string")
    assert index.search(old, version=version).count() == 0 < index.search(old).count()


def test_a_search_reads_the_row_groups_of_its_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "GROUP_BYTES", 20_000)
    docs = spark.range(4000).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.sha1(F.concat_ws("-", F.col("id"), k)))).alias("text"), F.lit("t").alias("title"))
    index = TextIndex(spark, str(tmp_path / "i"), COLUMNS)
    index.add(docs)
    rows = index.table.read()[1]["segments"][0]["rows"]
    term = docs.select(F.split("text", " ")[3]).first()[0]
    found = index.postings([term])
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.collectAsList() if hasattr(found._jdf, "collectAsList") else found.collect()
    leaf = plan.collectLeaves().head()
    read = leaf.metrics().get("numOutputRows").get().value()
    assert 0 < read < rows / 20, (read, rows)
