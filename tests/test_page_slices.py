"""Pages and their blocks are few Python objects at a time, however many rows a batch has."""

import pyarrow as pa

from lorewell.operators import ingest
from lorewell.sources import html


def test_batches_are_read_in_slices(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda frame, run, schema, own=type(spark.range(0)).mapInArrow: runs.append(run) or own(frame, run, schema))
    rows = [(i if i % 50 else None, None if i % 7 == 0 else f"<h1>T{i}</h1><p>text {i}</p>", f"u{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").coalesce(1)
    blocks = html.html_blocks(pages, "page_id", "html", "url")
    got = sorted((r.page_id or 0, r.section, r.text) for r in ingest.chunk_documents(blocks, "page_id").collect())
    assert got == sorted((i if i % 50 else 0, f"T{i}", f"text {i}") for i in range(300) if i % 7)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["page_id", "html", "url"])
    made = list(runs[0](iter([batch])))
    assert sum(b.num_rows for b in made) == 300 and max(b.num_rows for b in made) == html.SLICE
    whole = pa.Table.from_batches(made).select(["page_id", "path", "blocks"]).combine_chunks().to_batches()
    assert len(list(runs[1](iter(whole)))) == -(-300 // ingest.SLICE)
