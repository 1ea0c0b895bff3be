"""Hard negatives of anchor vectors by bit-sliced integer products.

Vectors are scaled to whole numbers and cut into bit planes, 64 components to a machine word.  A
product of two numbers is a sum over pairs of planes, and of 64 at once the ones of two words'
conjunction.  An anchor takes the planes of the rows most significant first.  What the planes that
are left can add lies between two bounds, so that each row's score lies in an interval that halves
with each plane, and a row goes once its interval can't reach a result any more: it lies below the
k-th best lower bound, or outside of all windows of scores that are asked for.

Anchors meet all rows in a grid: anchors are dealt into groups of bounded size, rows into others, and
a cell of the grid is one task's work with one group of each.  Either side is shuffled once for
each group of the other; nothing is broadcast or collected.  A cell answers with its best rows of
each anchor, of which the best of all cells are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.counts import partitions
from lorewell.session import written

#: Rows and anchors of a cell, and rows whose planes are held at a time.
CELL_ROWS, CELL_ANCHORS, BLOCK_ROWS = 1 << 17, 1 << 13, 1 << 15
#: Scaled components are held to this magnitude, and scores to that of a long.
LARGEST = float(1 << 53)
SCALE = 256
_LONG = (1 << 63) - 1


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """A row of whole numbers a vector; shorter vectors end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    out = np.zeros((len(size), int(size.max(initial=1)) or 1), np.int64)
    with np.errstate(over="ignore"):
        out[np.arange(out.shape[1]) < size[:, None]] = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST)
    return out


def planes(numbers: np.ndarray, bits: int, words: int) -> np.ndarray:
    """(bits + 1, words, rows) words of two's complement, the sign's plane last."""
    padded = np.zeros((len(numbers), words * 64), np.int64)
    padded[:, : numbers.shape[1]] = numbers
    out = np.empty((bits + 1, words, len(numbers)), np.uint64)
    for b in range(bits + 1):
        one = ((padded >> b) & 1).astype(np.uint8)
        out[b] = np.packbits(one, axis=1, bitorder="little").view(np.uint64).T
    return out


def weights(bits: int) -> list[int]:
    return [1 << b for b in range(bits)] + [-(1 << bits)]


class Rows:
    """A block of rows as planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray, bits: int, words: int):
        self.ids, self.labels, self.bits = ids, labels, bits
        self.planes, self.weights = planes(numbers, bits, words), weights(bits)

    def intervals(self, anchor: np.ndarray, at: np.ndarray, own: list[int], reach: tuple[int, int], exact):
        """Yields (rows, lowest, highest score) after each plane; what is sent back tells which rows stay."""
        partial = np.zeros(len(at), exact)
        for b in range(self.bits, -1, -1):
            words = self.planes[b][:, at]
            for c, weight in enumerate(own):
                ones = np.bitwise_count(anchor[c][:, None] & words).sum(axis=0, dtype=np.int64)
                partial = partial + ones.astype(exact) * (weight * self.weights[b])
            rest = (1 << b) - 1
            keep = yield at, partial + rest * reach[0], partial + rest * reach[1]
            at, partial = at[keep], partial[keep]
            if not len(at):
                return


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k first by score, higher first, then by id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


class Best:
    """The k best rows of one window of scores, over blocks."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high, self.rows = k, low, high, []

    def may(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which rows of these intervals can still be among the k best."""
        may, certain = np.ones(len(low), bool), low
        if self.low is not None:
            may = (high >= self.low) & (low <= self.high)
            certain = low[(low >= self.low) & (high <= self.high)]
        floor = self.rows[-1][0] if len(self.rows) == self.k else None
        if len(certain) >= self.k:
            own = np.partition(certain, len(certain) - self.k)[len(certain) - self.k]
            floor = own if floor is None else max(own, floor)
        return may if floor is None else may & (high >= floor)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero((scores >= self.low) & (scores <= self.high)) if self.low is not None else np.arange(len(scores))
        at = at[_best(scores[at], ids[at], self.k)]
        self.rows = sorted(self.rows + [(int(scores[i]), int(ids[i])) for i in at], key=lambda r: (-r[0], r[1]))[: self.k]


def _mine(anchors: pa.Table, rows: pa.Table, same: bool, windows, block_rows: int) -> list[list[Best]]:
    """For each anchor its best rows of the same or of other labels, in each window that ``windows(i)`` makes."""
    ids, labels = (np.asarray(rows[c].to_numpy(), np.int64) for c in ("id", "label"))
    own_ids, own_labels = (np.asarray(anchors[c].to_numpy(), np.int64) for c in ("id", "label"))
    a, x = whole_numbers(anchors["vector"]), whole_numbers(rows["vector"])
    width = max(a.shape[1], x.shape[1])
    words, most = -(-width // 64), [int(max(-(v.min(initial=0) + 1), v.max(initial=0), 1)).bit_length() for v in (a, x)]
    exact = np.int64 if width << (most[0] + most[1] + 3) < _LONG else object
    own_planes, own_weights = planes(a, most[0], words), weights(most[0])
    reach = [(int(np.minimum(v, 0).sum(dtype=exact)), int(np.maximum(v, 0).sum(dtype=exact))) for v in a]
    found = [windows(i) for i in range(len(a))]
    for first in range(0, len(ids), block_rows):
        part = slice(first, first + block_rows)
        block = Rows(ids[part], labels[part], x[part], most[1], words)
        for i, lists in enumerate(found):
            at = np.flatnonzero((block.labels == own_labels[i]) == same)
            at = at[block.ids[at] != own_ids[i]]
            if not lists or not len(at):
                continue
            steps, keep = block.intervals(own_planes[:, :, i], at, own_weights, reach[i], exact), None
            while True:
                try:
                    at, low, high = steps.send(keep)
                except StopIteration:
                    break
                keep = np.logical_or.reduce([w.may(low, high) for w in lists])
                left = at[keep], low[keep]
            for w in lists:
                w.add(left[1], block.ids[left[0]])
    return found


def _long(x: int) -> int:
    return max(-_LONG, min(_LONG, x))


def _positives(k: int):
    block_rows = BLOCK_ROWS

    def mine(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = _mine(anchors, rows, True, lambda i: [Best(k)], block_rows)
        out = [(a, r, _long(s)) for a, [best] in zip(anchors["id"].to_pylist(), found, strict=True) for s, r in best.rows]
        return pa.table({c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(("anchor_id", "positive_id", "positive_score"))})

    return mine


def _negatives(k: int, low: int, high: int):
    block_rows = BLOCK_ROWS

    def mine(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        of = anchors["positives"].to_pylist()
        bounds = lambda s: (-(-low * s // 100), high * s // 100)
        asked = [[p for p in ps if bounds(p["positive_score"])[0] <= bounds(p["positive_score"])[1]] for ps in of]
        found = _mine(anchors, rows, False, lambda i: [Best(k, *bounds(p["positive_score"])) for p in asked[i]], block_rows)
        out = [(a, p["positive_id"], r, p["positive_score"], _long(s)) for a, ps, lists in zip(anchors["id"].to_pylist(), asked, found, strict=True) for p, best in zip(ps, lists, strict=True) for s, r in best.rows]
        return pa.table({c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"))})

    return mine


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, mine, schema: str) -> DataFrame:
    """``mine`` over every cell of the grid of anchors and rows."""
    spark = rows.sparkSession
    high = max(1, -(-n_anchors // CELL_ANCHORS))
    wide = max(-(-partitions(spark) // high), -(-n_rows // CELL_ROWS))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = anchors.select("*", of(high).alias("i")).select("*", number(wide).alias("j"))
    right = rows.select("*", of(wide).alias("j")).select("*", number(high).alias("i"))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(mine, schema)


def _first(frame: DataFrame, k: int, keys: list[str], score: str, tie: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, id: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hardest negatives of each positive.

    ``anchor`` marks the anchors, ``label`` gives a row's label (else the column ``label``).
    An anchor's positives are its ``positives`` best other rows of its label; for each, the result
    has the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent
    of the positive's.  Scores are inner products of floor(256 * component); ties go to the
    smaller id.

    Cases: rows with a null id, label or vector or with a null or non-finite component take no part,
    nor do anchors of that kind.  Rows of one id are one row: that of the smallest label, then
    vector.  A vector that is shorter than another ends in zeros; scaled components are held to
    2^53, scores to a long.  A positive of negative score has no negatives, as its window is empty.
    Further columns are not looked at; an empty table has an empty result.
    """
    label = F.col("label") if label is None else label
    rows = vectors.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.*")
    rows, _ = written(rows)
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    chosen = rows.where("anchor").select(*[F.col(c).alias(c) for c in ("id", "label", "vector")])
    rows = rows.drop("anchor")
    best = _grid(chosen, rows, n_anchors, n_rows, _positives(positives), "anchor_id long, positive_id long, positive_score long")
    best = _first(best, positives, ["anchor_id"], "positive_score", "positive_id")
    mine = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    chosen = chosen.join(mine.withColumnRenamed("anchor_id", "id"), "id")
    found = _grid(chosen, rows, n_anchors, n_rows, _negatives(negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    return _first(found, negatives, ["anchor_id", "positive_id"], "negative_score", "negative_id").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
