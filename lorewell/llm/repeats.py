"""Byte strings that repeat across documents: maximal repeats of an enhanced suffix array, and texts without them.

Documents are packed into batches of a few MB, which are written once.  Of each window of LENGTH bytes
one string is an anchor (``anchors.py``), so that equal windows meet by their anchor's hash; what can hold a
shared window around an anchor is its context, LENGTH bytes to the right and LENGTH - ANCHOR to the left.

1. Batches count anchors by hashed ranges; those that occur once in the corpus go.
2. Batches send a hash, the smallest id and the number of each of their distinct contexts of shared
   anchors.  A range whose anchor has one context only knows its repeat, which is the whole context.
3. Of all other contexts, one batch each sends the bytes.  The range builds their suffix array, and the
   common prefixes of neighbours; a stack-scan walks the tree of common-prefix intervals and keeps those
   of LENGTH bytes or more whose members differ in the byte to their left.  These are the maximal repeats, with
   all their members, nested ones included.
4. Each batch is told the repeats within its contexts and the smallest id that holds each, and marks
   the bytes of every document that is not that one.

A context is sent once a batch, however often it occurs there.  An anchor of over HOT occurrences sends
the windows around it instead, each by its own hash, so that no range has to hold all contexts of a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import counts
from lorewell.llm.anchors import ANCHOR, anchors
from lorewell.llm.spans import column_bytes, hash_spans, mix
from lorewell.session import written

#: Bytes of a repeat, occurrences from which an anchor's windows go by themselves, and anchors of a range.
LENGTH, HOT, RANGE_ANCHORS = 50, 20_000, 1 << 18
#: An answer's end that stands for the end of the context.
WHOLE = 255
_U = np.uint64
_BATCH = "b long, ids array<long>, sizes array<long>, bytes long, text binary"
_TOLD = "b long, r int, kind int, a binary, d binary"


def packed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """A row for each few MB of consecutive documents: ids, sizes in bytes, and the compressed texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, parts, total, row = [], [], [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            blob = pa.compress(b"".join(parts), codec="zstd", asbytes=True)
            return pa.record_batch({"b": pa.array([row], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bytes": pa.array([total], pa.int64()), "text": pa.array([blob], pa.binary())})

        for batch in batches:
            raw, at = column_bytes(batch["text"])
            own, first = batch["id"].to_pylist(), 0
            while first < len(own):
                stop = max(first + 1, int(np.searchsorted(at, at[first] + counts.BATCH_BYTES - total, "right")) - 1)
                ids += own[first:stop]
                sizes += np.diff(at[first : stop + 1]).tolist()
                parts.append(raw[at[first] : at[stop]].tobytes())
                total, first = total + int(at[stop] - at[first]), stop
                if total >= counts.BATCH_BYTES * 3 // 4:
                    yield flush()
                    ids, sizes, parts, total, row = [], [], [], 0, row + 1
        if ids:
            yield flush()

    table, _ = written(docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(pack, _BATCH))
    return table


class Batch:
    """The documents of a packed row, and the anchors of those with an id."""

    def __init__(self, row: dict):
        self.b = row["b"]
        total = row["bytes"]
        self.raw = np.frombuffer(pa.decompress(row["text"], decompressed_size=total, codec="zstd", asbytes=True), np.uint8) if total else np.zeros(0, np.uint8)
        self.at = np.r_[0, np.cumsum(np.array(row["sizes"], np.int64))].astype(np.int64)
        self.null = np.array([i is None for i in row["ids"]], bool)
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        place, key = anchors(self.raw, self.at, LENGTH)
        doc = np.searchsorted(self.at, place, "right") - 1
        on = ~self.null[doc]
        self.place, self.key, self.doc = place[on], key[on], doc[on]

    def contexts(self, answers: pa.Table, bits: int, hot_from: int) -> None:
        """The distinct contexts of shared anchors, by range, and the context, start and document of each occurrence."""
        keys, _, where = counts.cut(self.key, np.ones(len(self.key), np.int64), bits)
        total = counts.totals(answers, keys, bits)[where] if len(keys) else np.zeros(0, np.int64)
        on = np.flatnonzero((total > 1) & (total <= hot_from))
        place, doc = self.place[on], self.doc[on]
        start, end = np.maximum(self.at[doc], place - (LENGTH - ANCHOR)), np.minimum(self.at[doc + 1], place + LENGTH)
        key = self.key[on]
        hot = np.flatnonzero(total > hot_from)
        if len(hot):  # each window around the anchor, by its own hash
            first = (self.place[hot][:, None] - np.arange(LENGTH - ANCHOR + 1)).ravel()
            of = np.repeat(self.doc[hot], LENGTH - ANCHOR + 1)
            fits = (first >= self.at[of]) & (first + LENGTH <= self.at[of + 1])
            first, at = np.unique(first[fits], return_index=True)
            of = of[fits][at]
            start, end, doc = np.r_[start, first], np.r_[end, first + LENGTH], np.r_[doc, of]
            key = np.r_[key, mix(hash_spans(self.raw, first, first + LENGTH) + _U(1))]
        text = hash_spans(self.raw, start, end)
        order = np.lexsort((text, key))
        key, text, self.start, end, self.of = key[order], text[order], start[order], end[order], doc[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])] if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.context = np.cumsum(new) - 1
        self.keys, self.texts, self.first, self.sizes = key[first], text[first], self.start[first], (end - self.start)[first]
        self.owner = np.minimum.reduceat(self.ids[self.of], first) if len(first) else np.zeros(0, np.int64)
        self.number = np.diff(np.r_[first, len(key)])
        self.edges = np.searchsorted(self.keys >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=_U))

    def ranges(self) -> Iterator[tuple[int, slice]]:
        for r in np.flatnonzero(np.diff(self.edges)):
            yield int(r), slice(int(self.edges[r]), int(self.edges[r + 1]))


def _squeeze(x: np.ndarray) -> bytes:
    return counts.squeeze(x.astype(np.int64).view(_U), 8)


def _unsqueeze(raw: bytes) -> np.ndarray:
    return counts.unsqueeze(raw, 8).view(np.int64)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_TOLD_ROWS = pa.schema([("b", pa.int64()), ("r", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("d", pa.binary())])
_SENT = "r int, b long, keys binary, texts binary, owner binary, number binary"
_SENT_ROWS = pa.schema([("r", pa.int32()), ("b", pa.int64()), *[(c, pa.binary()) for c in ("keys", "texts", "owner", "number")]])
_BYTES = "r int, b long, sizes binary, text binary"
_BYTES_ROWS = pa.schema([("r", pa.int32()), ("b", pa.int64()), ("sizes", pa.binary()), ("text", pa.binary())])


def _told(told: pa.Table, kind: int) -> pa.Table:
    return told.filter(pa.array(np.asarray(told["kind"].to_numpy()) == kind))


def _batch(table: pa.Table, told: pa.Table, how: tuple[int, int]) -> Batch:
    batch, shared = Batch(table.to_pylist()[0]), _told(told, 0)
    batch.contexts(pa.table({"r": shared["r"], "seen": shared["a"], "n": shared["d"]}), *how)
    return batch


def _send(table: pa.Table, told: pa.Table, how: tuple[int, int]) -> pa.Table:
    """Each range's contexts: anchor and text by hash, smallest id, occurrences."""
    if not table.num_rows:
        return _table([], _SENT_ROWS)
    x = _batch(table, told, how)
    rows = [(r, x.b, counts.squeeze(np.diff(x.keys[s], prepend=_U(0)), 8), x.texts[s].tobytes(), _squeeze(x.owner[s]), counts.squeeze(x.number[s], 4)) for r, s in x.ranges()]
    return _table(rows, _SENT_ROWS)


class Contexts:
    """The contexts that all batches sent to a range."""

    def __init__(self, table: pa.Table):
        rows = sorted(table.to_pylist(), key=lambda row: row["b"])
        self.r, self.batches = rows[0]["r"], [row["b"] for row in rows]
        keys = [np.cumsum(counts.unsqueeze(row["keys"], 8), dtype=_U) for row in rows]
        self.ends = np.cumsum([len(k) for k in keys])
        key, text = np.concatenate(keys), np.concatenate([np.frombuffer(row["texts"], _U) for row in rows])
        owner, number = np.concatenate([_unsqueeze(row["owner"]) for row in rows]), np.concatenate([counts.unsqueeze(row["number"], 4).astype(np.int64) for row in rows])
        order = np.lexsort((text, key))
        key, text = key[order], text[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])]
        first = np.flatnonzero(new)
        self.of = np.empty(len(key), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.owner, self.number = np.minimum.reduceat(owner[order], first), np.add.reduceat(number[order], first)
        anchor = np.cumsum(np.r_[True, key[first][1:] != key[first][:-1]]) - 1
        self.many = np.bincount(anchor)[anchor] > 1
        self.sender = order[first]  # a stable sort: the first batch that has it

    def parts(self) -> Iterator[tuple[int, slice]]:
        start = 0
        for b, end in zip(self.batches, self.ends.tolist(), strict=True):
            yield b, slice(start, end)
            start = end


def _ask(table: pa.Table) -> pa.Table:
    """Which of its contexts each batch is to send in full."""
    x = Contexts(table)
    asked = np.zeros(len(x.of), bool)
    asked[x.sender[x.many]] = True
    return _table([(b, x.r, 1, np.packbits(asked[s]).tobytes(), b"") for b, s in x.parts() if asked[s].any()], _TOLD_ROWS)


def _send_bytes(table: pa.Table, told: pa.Table, how: tuple[int, int]) -> pa.Table:
    if not table.num_rows:
        return _table([], _BYTES_ROWS)
    asked = {row["r"]: row["a"] for row in _told(told, 1).to_pylist()}
    if not asked:
        return _table([], _BYTES_ROWS)
    x, rows = _batch(table, told, how), []
    for r, s in x.ranges():
        if r in asked:
            at = s.start + np.flatnonzero(np.unpackbits(np.frombuffer(asked[r], np.uint8), count=s.stop - s.start))
            text = b"".join(x.raw[i : i + n].tobytes() for i, n in zip(x.first[at].tolist(), x.sizes[at].tolist(), strict=True))
            rows.append((r, x.b, x.sizes[at].astype(np.uint8).tobytes(), len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)))
    return _table(rows, _BYTES_ROWS)


def suffixes(text: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The enhanced suffix array of many short texts, for suffixes of LENGTH bytes or more.

    Text and place of each suffix in order, bytes in common with the one before, and the byte to its left
    (256 at a text's start).
    """
    many = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(sizes)), many)
    place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    begin, left = start[of] + place, sizes[of] - place
    width = 2 * LENGTH - ANCHOR
    padded = np.zeros(len(text) + width, np.uint8)
    padded[: len(text)] = text
    table = np.zeros((len(of), width + 1), np.uint8)
    table[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[begin]
    table[:, :width][np.arange(width) >= left[:, None]] = 0
    table[:, width] = left  # a text before those that go on with zeros
    order = np.argsort(table.view(f"S{width + 1}").ravel(), kind="stable")
    table, left = table[order], left[order]
    differ = table[1:, :width] != table[:-1, :width]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.r_[0, np.minimum(common, np.minimum(left[1:], left[:-1]))] if len(of) else np.zeros(0, np.int64)
    before = np.where(place > 0, padded[begin - 1].astype(np.int64), 256)
    return of[order], place[order], common, before[order]


def intervals(common: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first, end) of the common-prefix intervals of LENGTH or more whose members differ to the left, by a stack-scan."""
    long = np.flatnonzero(common >= LENGTH)
    if not len(long):
        return
    gap = np.flatnonzero(np.diff(long) > 1)
    firsts, ends = long[np.r_[0, gap + 1]] - 1, long[np.r_[gap, len(long) - 1]] + 1
    cuts = np.c_[firsts, ends].ravel()
    low, high = (f.reduceat(np.append(before, before[-1]), cuts)[::2] for f in (np.minimum, np.maximum))
    varied = (low != high) | (high == 256)  # no interval within another run can differ to the left
    for first, end in zip(firsts[varied].tolist(), ends[varied].tolist(), strict=True):
        depths, lefts, stack = common[first:end].tolist(), before[first:end].tolist(), []
        for i in range(1, end - first + 1):
            depth = depths[i] if i < end - first else 0
            begin, left = i - 1, lefts[i - 1]
            while stack and stack[-1][0] > depth:
                length, begin, mark = stack.pop()
                left = left if mark == left else 256
                if left == 256:
                    yield length, first + begin, first + i
            if stack and stack[-1][0] == depth:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == left else 256
            elif depth:
                stack.append([depth, begin, left])


def _repeats(x: Contexts, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context, start, end and smallest id of each member of each maximal repeat of a range."""
    alone = np.flatnonzero(~x.many & (x.number > 1))
    found = [(alone, np.zeros(len(alone), np.int64), np.full(len(alone), WHOLE), x.owner[alone])]
    if x.many.any():
        sent = {row["b"]: row for row in rows}
        asked = np.zeros(len(x.of), bool)
        asked[x.sender[x.many]] = True
        parts = [(s, sent[b]) for b, s in x.parts() if asked[s].any()]
        context = np.concatenate([x.of[s][asked[s]] for s, _ in parts])
        sizes = np.concatenate([np.frombuffer(row["sizes"], np.uint8) for _, row in parts]).astype(np.int64)
        text = np.concatenate([np.frombuffer(pa.decompress(row["text"][8:], decompressed_size=int.from_bytes(row["text"][:8], "little"), codec="zstd", asbytes=True), np.uint8) for _, row in parts])
        of, place, common, before = suffixes(text, np.cumsum(sizes) - sizes, sizes)
        of = context[of]
        for length, first, end in intervals(common, before):
            who = of[first:end]
            found.append((who, place[first:end], place[first:end] + length, np.full(end - first, x.owner[who].min())))
        # a context that occurs again as a whole, if only within one document or its copies
        whole = np.flatnonzero(x.many & (x.number > 1))
        found.append((whole, np.zeros(len(whole), np.int64), np.full(len(whole), WHOLE), x.owner[whole]))
    who, start, end, owner = (np.concatenate([f[i] for f in found]) for i in range(4))
    order = np.argsort(who, kind="stable")
    return who[order], start[order], end[order], owner[order]


def _answer(table: pa.Table, sent: pa.Table) -> pa.Table:
    """For each context of each batch the repeats within it: their number, starts and ends, and smallest ids."""
    if not table.num_rows:
        return _table([], _TOLD_ROWS)
    x = Contexts(table)
    who, start, end, owner = _repeats(x, sent.to_pylist())
    first, many = np.searchsorted(who, np.arange(len(x.owner))), np.bincount(who, minlength=len(x.owner))
    rows = []
    for b, s in x.parts():
        of = x.of[s]
        n = many[of]
        at = np.repeat(first[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows.append((b, x.r, 2, counts.squeeze(np.r_[n, start[at], end[at]], 4), _squeeze(owner[at])))
    return _table(rows, _TOLD_ROWS)


def _occurrences(table: pa.Table, told: pa.Table, how: tuple[int, int]) -> tuple[Batch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch, and document, start, end and smallest id of each occurrence of a repeat in it."""
    x = _batch(table, told, how)
    answers = {row["r"]: row for row in _told(told, 2).to_pylist()}
    n, starts, ends, owners = [], [], [], []
    for r, s in x.ranges():
        a, size = counts.unsqueeze(answers[r]["a"], 4).astype(np.int64), s.stop - s.start
        n.append(a[:size])
        starts.append(a[size : size + a[:size].sum()])
        ends.append(a[size + a[:size].sum() :])
        owners.append(_unsqueeze(answers[r]["d"]))
    n, starts, ends, owners = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (n, starts, ends, owners))
    first = np.cumsum(n) - n
    many = n[x.context] if len(x.context) else np.zeros(0, np.int64)
    place = np.repeat(np.arange(len(x.context)), many)
    at = np.repeat(first[x.context] if len(x.context) else many, many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
    size = x.sizes[x.context[place]]
    begin = x.start[place]
    return x, x.of[place], begin + starts[at], begin + np.where(ends[at] == WHOLE, size, ends[at]), owners[at]


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_KEPT_ROWS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _remove(table: pa.Table, told: pa.Table, how: tuple[int, int]) -> pa.Table:
    x, doc, start, end, owner = _occurrences(table, told, how)
    lost = owner < x.ids[doc]
    depth = np.bincount(start[lost], minlength=len(x.raw) + 1) - np.bincount(end[lost], minlength=len(x.raw) + 1)
    gone = np.cumsum(depth)[: len(x.raw)] > 0
    before = np.r_[0, np.cumsum(gone)]
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    inner = x.at[1:-1][x.at[1:-1] < len(x.raw)]
    opens[inner] = gone[inner]  # a document's own spans
    spans = np.r_[0, np.cumsum(opens)]
    kept = x.raw[~gone]
    place = x.at - before[x.at]
    data = kept.tobytes()
    texts = [data[a:b] for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
    ids = pa.array(x.ids, pa.int64(), mask=x.null)
    return pa.table([ids, pa.array(np.diff(x.at)), pa.array(np.diff(before[x.at])), pa.array(np.diff(spans[x.at])), pa.array(texts, pa.binary())], schema=_KEPT_ROWS)


_MEMBER = "repeat long, length long, doc_id long, start long"
_MEMBER_ROWS = pa.schema([("repeat", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])


def _members(table: pa.Table, told: pa.Table, how: tuple[int, int]) -> pa.Table:
    x, doc, start, end, _ = _occurrences(table, told, how)
    _, one = np.unique(np.c_[start, end], axis=0, return_index=True) if len(start) else (None, np.zeros(0, np.int64))
    doc, start, end = doc[one], start[one], end[one]
    return pa.table([pa.array(hash_spans(x.raw, start, end).view(np.int64)), pa.array(end - start), pa.array(x.ids[doc]), pa.array(start - x.at[doc])], schema=_MEMBER_ROWS)


def _run(docs: DataFrame, id: str, text: str, emit, schema: str) -> DataFrame:
    batches = packed(docs, id, text)
    size = batches.agg(F.sum("bytes")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, size * 2 / (LENGTH - ANCHOR + 2) / RANGE_ANCHORS)))))

    how = bits, HOT

    def keys_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        batch = Batch(row)
        return batch.key, np.ones(len(batch.key), np.int64)

    def told_with(f, given: DataFrame, schema: str) -> DataFrame:
        return batches.groupBy("b").cogroup(given.groupBy("b")).applyInArrow(lambda a, b: f(a, b, how), schema)

    shared = counts.shared_counts_of_rows(batches, keys_of, bits).select("b", "r", F.lit(0).alias("kind"), F.col("seen").alias("a"), F.col("n").alias("d"))
    shared, _ = written(shared)
    sent, _ = written(told_with(_send, shared, _SENT))
    asked, _ = written(sent.groupBy("r").applyInArrow(_ask, _TOLD))
    full = told_with(_send_bytes, shared.union(asked), _BYTES)
    answers = sent.groupBy("r").cogroup(full.groupBy("r")).applyInArrow(_answer, _TOLD)
    return told_with(emit, shared.union(answers), schema)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every document without the strings of 50 bytes that a smaller id has, too.

    ``kept`` holds the bytes that are left, which need not be whole characters.  Strings are judged on the
    texts as given.

    Cases: a null or empty text has no bytes; a text below 50 bytes loses none.  A document with a null id
    neither loses bytes nor takes any from others, and rows of one id don't take from each other.
    Repeated rows are documents of their own.  Texts of any length are taken whole.  Further columns
    are not looked at; an empty table has an empty result.
    """
    return _run(docs, id, text, _remove, _KEPT)


def maximal_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(repeat, length, doc_id, start): all occurrences of the repeated strings of 50 bytes or more, by the string's hash.

    ``start`` counts bytes.  A string is as long as its occurrences agree within an anchor's context, so that a longer passage
    is found as the overlapping repeats of its anchors.  Cases: as ``remove_repeats``; repeats within one document count.
    """
    return _run(docs, id, text, _members, _MEMBER).distinct()
