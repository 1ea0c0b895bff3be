"""Packing of examples into training sequences: vector bin packing by dot product.

A sequence has limits on tokens, on segments and on loss-bearing tokens.  The next example
for it is the one whose demands, as shares of the limits, have the largest dot product
with what the sequence has left, among those that fit in all three.  Where none fits and
examples may be cut, the best is cut to what is left.  Every task packs its own rows from a
pool of bounded size, so that no row moves and no task waits for another.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Examples that a task chooses from at once.
POOL = 256


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 2048
    loss_tokens: int = 2048


@dataclass
class Piece:
    """Tokens ``start`` to ``start + length`` of example ``item``; ``loss`` of them bear loss."""

    item: int
    start: int
    length: int
    loss: int


class Packer:
    """Feed examples, take closed sequences (lists of pieces); ``finish`` gives the rest.

    ``loss`` of an example is None if all its tokens bear loss, or an array of its loss
    tokens before each token (one more than tokens).
    """

    def __init__(self, limits: Limits, cut: bool = True) -> None:
        if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
            raise ValueError("a sequence must hold a token")
        self.limits, self.cut = limits, cut
        self.caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.pool: list[Piece] = []
        self.pooled = 0
        self.needs = np.zeros((4 * POOL, 3))
        self.before: dict[int, np.ndarray | None] = {}

    def _loss(self, item: int, start: int, length: int) -> int:
        before = self.before[item]
        return length if before is None else int(before[start + length] - before[start])

    def _take(self, item: int, start: int, length: int, tokens: int, loss: int) -> int:
        """The most tokens from ``start`` that fit in so many tokens and loss-bearing tokens."""
        most = min(length, tokens)
        before = self.before[item]
        if before is None:
            return min(most, loss)
        return int(np.searchsorted(before[start : start + most + 1], before[start] + loss, "right")) - 1

    def feed(self, item: int, length: int, before: np.ndarray | None = None) -> Iterator[list[Piece]]:
        """An example; yields the sequences that are full with it."""
        self.before[item] = before
        start = 0
        while length - start:
            n = self._take(item, start, length - start, self.limits.tokens, self.limits.loss_tokens)
            if n == length - start and n < self.limits.tokens:
                break
            yield [Piece(item, start, n, self._loss(item, start, n))]
            start += n
        if length - start:
            self._pool(Piece(item, start, length - start, self._loss(item, start, length - start)))
        if len(self.pool) >= 2 * POOL and self.pooled >= self.limits.tokens:
            while len(self.pool) >= POOL and self.pooled >= self.limits.tokens:
                yield self._fill()

    def _pool(self, piece: Piece) -> None:
        if len(self.pool) == len(self.needs):
            self.needs = np.vstack([self.needs, np.zeros_like(self.needs)])
        self.needs[len(self.pool)] = (piece.length, 1, piece.loss)
        self.pool.append(piece)
        self.pooled += piece.length

    def _pop(self, i: int) -> Piece:
        piece, last = self.pool[i], self.pool.pop()
        self.pooled -= piece.length
        if i < len(self.pool):
            self.pool[i] = last
            self.needs[i] = self.needs[len(self.pool)]
        return piece

    def _fill(self) -> list[Piece]:
        left, out = self.caps.copy(), []
        weight = 1 / (self.caps * self.caps)
        while self.pool and left[0] > 0 and left[1] > 0:
            needs = self.needs[: len(self.pool)]
            score = needs @ (left * weight)
            fits = (needs <= left).all(axis=1)
            if fits.any():
                piece = self._pop(int(np.where(fits, score, -1).argmax()))
            elif self.cut:
                i = int(score.argmax())
                whole = self.pool[i]
                n = self._take(whole.item, whole.start, whole.length, int(left[0]), int(left[2]))
                if n <= 0:
                    break
                self._pop(i)
                piece = Piece(whole.item, whole.start, n, self._loss(whole.item, whole.start, n))
                self._pool(Piece(whole.item, whole.start + n, whole.length - n, whole.loss - piece.loss))
            else:
                break
            out.append(piece)
            left -= (piece.length, 1, piece.loss)
        return out

    def finish(self) -> Iterator[list[Piece]]:
        """The rest.  If examples may be cut, a sequence that is not full is cut at powers of two, which need no padding."""
        while self.pool:
            pieces = self._fill()
            total = sum(p.length for p in pieces)
            if not self.cut or total == self.limits.tokens or not total:
                yield pieces
                continue
            while total:
                room, out = 1 << (total.bit_length() - 1), []
                total -= room
                while room:
                    p = pieces.pop(0)
                    n = min(room, p.length)
                    out.append(Piece(p.item, p.start, n, self._loss(p.item, p.start, n)))
                    if n < p.length:
                        pieces.insert(0, Piece(p.item, p.start + n, p.length - n, p.loss - out[-1].loss))
                    room -= n
                yield out


_ENCODERS: dict = {}


def encoder(path: str):
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        from lorewell.llm.tokens import Encoder

        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _examples(batch: pa.RecordBatch, vocabulary: str, end_id: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, ids, ids of the prompt) of the rows of a batch of id, text and perhaps prompt."""
    code = encoder(vocabulary).encode
    for first, got, at in code(batch.column(1)):
        n = len(at) - 1
        asked: list[np.ndarray] = []
        if batch.num_columns > 2:
            for _, ids, cuts in code(batch.column(2).slice(first, n)):
                asked += [ids[a:b] for a, b in itertools.pairwise(cuts)]
        for i in range(n):
            head = asked[i] if asked else got[:0]
            yield first + i, np.concatenate([head, got[at[i] : at[i + 1]], np.array([end_id], got.dtype)]).astype("<u4"), len(head)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """Per piece: (``id_col``, start, length, ids, doc_tokens, loss_tokens, sequence_id, offset).

    A document is the ids of its text under the vocabulary file (which every executor has
    at the same path) and then ``end_id``; ids is a piece's part of them as little-endian
    32-bit words.  With ``prompt_col``, the ids of the prompt come before them and bear no
    loss; all others do, and loss_tokens counts them in a piece.  Each id is in one piece,
    offsets of a sequence have no gap, and no sequence exceeds the limits.  Cases: a null or
    empty text is the end id alone, a null prompt is none; a very long text is cut, and its ids
    are held until its last piece is placed; of examples with equal dot products, the
    first of the pool is taken; rows of one id are packed each on its own; a null id
    passes through; an empty table gives no row; further columns are ignored, whatever their names.
    """
    limits = limits or Limits()

    def run(batches):
        packer, ids, names = Packer(limits), {}, {}
        sequence = TaskContext.get().partitionId() << 33
        open_: dict[int, int] = {}
        cols: list[list] = [[] for _ in range(8)]

        def put(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for p in pieces:
                whole = ids[p.item]
                for c, v in zip(cols, (names[p.item], p.start, p.length, whole[p.start : p.start + p.length].tobytes(), len(whole), p.loss, sequence, offset), strict=True):
                    c.append(v)
                offset += p.length
                open_[p.item] -= p.length
                if not open_[p.item]:
                    del open_[p.item], ids[p.item], names[p.item], packer.before[p.item]
            sequence += bool(pieces)

        def flush() -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"])
            for c in cols:
                c.clear()
            return out

        item = 0
        for batch in batches:
            kind = batch.column(0).type
            own = batch.column(0).to_pylist()
            for row, whole, asked in _examples(batch, vocabulary, end_id):
                ids[item], names[item], open_[item] = whole, own[row], len(whole)
                before = np.maximum(np.arange(len(whole) + 1) - asked, 0) if batch.num_columns > 2 else None
                for pieces in packer.feed(item, len(whole), before):
                    put(pieces)
                item += 1
                if len(cols[0]) > 1000:
                    yield flush()
        for pieces in packer.finish():
            put(pieces)
            if len(cols[0]) > 1000:
                yield flush()
        if item:
            yield flush()

    kind_sql = docs.schema[id_col].dataType.simpleString()
    columns = {"id": id_col, "text": text_col} | ({"prompt": prompt_col} if prompt_col else {})
    chosen = docs.select(*[F.col(c).alias(k) for k, c in columns.items()])
    out = chosen.mapInArrow(run, f"id {kind_sql}, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
