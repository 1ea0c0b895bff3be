"""Ingest: what to do with each file, chunks of sections, and progress of sources."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T

#: Tokens (a quarter of the characters) that a chunk aims at, has at most, and shares with the next.
TARGET, MOST, OVERLAP = 320, 512, 48
#: Documents of a batch that are Python objects at once.
SLICE = 128
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def incremental_actions(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, action) of a listing (path, content_hash, mtime) against the manifest (and status).

    insert, delete, retry (a dependency was missing), skip (same time), refresh (same content), replace.
    """
    both = listing.alias("l").join(manifest.alias("m"), F.col("l.path") == F.col("m.path"), "full")
    action = (
        F.when(F.col("l.path").isNull(), "delete")
        .when(F.col("m.path").isNull(), "insert")
        .when(F.col("m.status") == "missing_dep", "retry")
        .when(F.abs(F.col("l.mtime") - F.col("m.mtime")) < 1e-6, "skip")
        .when(F.col("l.content_hash") == F.col("m.content_hash"), "refresh")
        .otherwise("replace")
    )
    return both.select(F.coalesce("l.path", "m.path").alias("path"), action.alias("action"))


def collection_for(path: Column, rules: dict[str, str], default: str | None = None) -> Column:
    """The collection of a path: the first rule that fits (a bare name is a segment, a glob the whole path), else the default or the top folder."""
    out = None
    for rule, name in rules.items():
        glob = any(c in rule for c in "*?[")
        if glob:
            body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in rule)
            fits = path.rlike(f"(?s)^{body}$")
        else:
            fits = F.array_contains(F.split(path, "/"), rule)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    top = F.get(F.split(path, "/"), F.lit(0))
    last = F.lit(default) if default else F.when(F.instr(path, "/") > 0, top).otherwise("library")
    return last if out is None else out.otherwise(last)


def upsert(known: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``known`` with the same key; of several new ones, the last by ``order``."""
    if order is not None:
        last = Window.partitionBy(key).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return new.unionByName(known.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def kept_vectors(vectors: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
    """Vectors without those of replaced rows, whose texts they no longer are of."""
    return vectors.join(replaced.select(key).distinct(), key, "left_anti")


def delete_by_path(chunks: DataFrame, gone: DataFrame, path: str) -> DataFrame:
    return chunks.join(gone.select(path).distinct(), path, "left_anti")


def stats_by_source(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.groupBy(F.coalesce(F.col(source), F.lit("?")).alias("source_type")).agg(F.count("*").alias("n"))


def source_progress(chunks: DataFrame, distilled: DataFrame, dupes: DataFrame, source: str, key: str = "doc_id") -> DataFrame:
    """Per source: chunks, those distilled, those that are duplicates, and those that wait."""
    mark = lambda f, name: f.select(key).distinct().withColumn(name, F.lit(1))
    rows = chunks.select(key, source).join(mark(distilled, "x"), key, "left").join(mark(dupes, "y"), key, "left")
    return rows.groupBy(source).agg(F.count("*").alias("chunks"), F.count("x").alias("distilled"), F.count("y").alias("dupes"), F.count_if(F.col("x").isNull() & F.col("y").isNull()).alias("pending"))


def pending_sources(chunks: DataFrame, distilled: DataFrame, source: str, at: str, limit: int, key: str = "doc_id") -> DataFrame:
    """The sources with chunks that are not distilled, the newest first."""
    waiting = chunks.join(distilled.select(key), key, "left_anti")
    return waiting.groupBy(source).agg(F.countDistinct(key).alias("waiting"), F.max(at).alias("newest")).orderBy(F.desc("newest"), source).limit(limit)


def split_long(text: str, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Sentences packed to at most ``most`` tokens, each piece starting with the end of the one before."""
    size, tail = most * 4, overlap * 4
    room = max(1, size - tail)
    out: list[str] = []
    held = ""
    for sentence in _SENTENCE.split(text):
        cuts = [sentence[i : i + room] for i in range(0, len(sentence), room)] or [""]
        for part in cuts:
            if held and len(held) + len(part) + 1 > size:
                out.append(held.strip())
                held = f"{held[-tail:] if tail else ''} {part}".strip()
            else:
                held = f"{held} {part}".strip() if held else part
    return [*out, held.strip()] if held.strip() else out


def chunk_blocks(blocks: list[tuple[str, str]], target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[str, str, int]]:
    """(section, text, tokens): blocks of one heading joined up to the target, long ones split."""
    tokens = lambda t: max(1, len(t) // 4)
    out: list[tuple[str, str, int]] = []
    section, parts = "", ""

    def close() -> None:
        nonlocal parts
        whole, parts = parts.strip(), ""
        if whole:
            out.extend((section, p, tokens(p)) for p in (split_long(whole, most, overlap) if tokens(whole) > most else [whole]))

    for head, text in blocks:
        head, text = head or "", (text or "").strip()
        if not text:
            continue
        if parts and (head != section or tokens(parts) >= target):
            close()
        section = head
        parts = f"{parts}\n{text}" if parts else text
        if tokens(parts) >= target:
            close()
    close()
    return out


def chunk_documents(blocks: DataFrame, key: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(key, seq, id, section, text, tokens) of documents with path and blocks (an array of section and text).

    The text is cleaned, empty pieces are dropped, and ids are over the cleaned text.
    """
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                cut = [chunk_blocks([(b["section"], b["text"]) for b in own or ()], target, most, overlap) for own in rows.column(2).to_pylist()]
                of = pa.array([i for i, own in enumerate(cut) for _ in own], pa.int64())
                flat = [(i, *piece) for own in cut for i, piece in enumerate(own)]
                column = lambda k, kind: pa.array([r[k] for r in flat], kind)
                made = [column(0, pa.int32()), column(1, pa.string()), column(2, pa.string()), column(3, pa.int32())]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(of), rows.column(1).take(of), *made], [key, "path", "seq", "section", "raw", "tokens"])

    pieces = blocks.select(key, "path", "blocks").mapInArrow(run, f"{key} {kind}, path string, seq int, section string, raw string, tokens int")
    cleaned = pieces.withColumn("text", T.clean(F.col("raw"))).where("text <> ''")
    return cleaned.select(key, "seq", T.chunk_id(F.col("path"), F.col("section"), F.col("text")).alias("id"), "section", "text", "tokens")


def recard_pending(chunks: DataFrame, done: DataFrame, version: int, source: str, key: str = "doc_id") -> DataFrame:
    """Per source, distilled chunks whose cards (key, version) are of an older version."""
    old = done.where(F.coalesce("version", F.lit(0)) < version).select(key)
    return chunks.join(old, key, "left_semi").groupBy(source).agg(F.count("*").alias("n"))
