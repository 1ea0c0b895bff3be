"""A quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Every word has a sparse random index vector, a function of its hash.  The vector of a word is
the sum of the index vectors around it in the training texts; words share a bounded number
of hashed rows.  Words count twice: as they are, and as their shape (classes of characters,
runs as one).  A document is the mean of its words' vectors, of its shapes' vectors, and a few
shares.  A two-layer network in numpy gives a probability, whose temperature is set on
training documents that the network has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import sampling, spans
from lorewell.llm.graph import saved

#: Labelled documents that the model is fitted on, at most (those of the smallest hash of the id).
TRAINING_DOCS = 3000
#: Rows and columns of the word vectors; other entries of an index vector; words around a word.
WORD_ROWS, SHAPE_ROWS, DIM, ENTRIES, AROUND = 1 << 14, 1 << 10, 48, 4, 2
HIDDEN, EPOCHS, RATE, DECAY, SEED = 24, 60, 0.01, 1e-3, 17
#: Share of the training documents that the temperature is set on.
CALIBRATION = 0.25
_U = np.uint64

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, of their shapes, whether a word repeats the one before, and documents."""
    starts, ends, doc = spans.words(raw, at)
    low = spans.hash_spans(spans.LOWER[raw], starts, ends)
    kind = _SHAPE[raw]
    first = np.zeros(len(raw), bool)
    first[starts] = True
    keep = ~spans.SPACE[raw]
    keep[1:] &= first[1:] | (kind[1:] != kind[:-1])
    place = np.r_[0, np.cumsum(keep)]
    shape = spans.hash_spans(kind[keep], place[starts], place[ends])
    again = np.zeros(len(low), bool)
    again[1:] = (low[1:] == low[:-1]) & (doc[1:] == doc[:-1])
    return low, shape, again, doc


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Sparse random vectors of +1 and -1, one a row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, DIM), np.float32)
    at = np.argsort(rng.random((rows, DIM)), axis=1)[:, :ENTRIES]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (rows, ENTRIES)), axis=1)
    return out


def _mean(table: np.ndarray, ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    out = np.zeros((docs, table.shape[1]), np.float32)
    if len(ids):
        full, first = np.unique(doc, return_index=True)
        out[full] = np.add.reduceat(table[ids], first, axis=0) / np.diff(np.r_[first, len(ids)])[:, None]
    return out


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def features(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, shape, again, doc = tokens(raw, at)
        docs = len(at) - 1
        w, s = (low % _U(WORD_ROWS)).astype(np.int64), (shape % _U(SHAPE_ROWS)).astype(np.int64)
        n = np.bincount(doc, minlength=docs)
        shares = np.stack([np.log1p(n), np.bincount(doc, again, docs) / np.maximum(n, 1)], axis=1)
        return np.hstack([_mean(self.words, w, doc, docs), _mean(self.shapes, s, doc, docs), shares]).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.maximum((x - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2).ravel()

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """In double precision, rounded: a document's score is the same whatever documents share its batch."""
        z = np.clip(self.logits(self.features(raw, at).astype(np.float64)) / self.temperature, -30, 30)
        return np.round(1 / (1 + np.exp(-z)), 7)


def word_vectors(h: np.ndarray, doc: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """Unit vectors of hashed words: own and surrounding index vectors, damped by how often the word occurs."""
    index = index_vectors(rows, seed)
    ids = (h % _U(rows)).astype(np.int64)
    out = np.zeros((rows, DIM), np.float32)
    for step in range(-AROUND, AROUND + 1):
        a, b = (ids[step:], ids[: len(ids) - step]) if step >= 0 else (ids[:step], ids[-step:])
        same = doc[step:] == doc[: len(doc) - step] if step >= 0 else doc[:step] == doc[-step:]
        for start in range(0, len(a), 1 << 16):
            cut = slice(start, start + (1 << 16))
            np.add.at(out, a[cut][same[cut]], index[b[cut][same[cut]]] * np.float32(2 if step == 0 else 1))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 0, out / np.maximum(size, 1e-9), index / np.float32(ENTRIES**0.5)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray) -> Model:
    """A model fitted on some texts with labels 0 and 1."""
    raw, at = spans.column_bytes(pa.array(texts, pa.string()))
    low, shape, _, doc = tokens(raw, at)
    model = Model(word_vectors(low, doc, WORD_ROWS, SEED), word_vectors(shape, doc, SHAPE_ROWS, SEED + 1), np.zeros(1), np.ones(1), [])
    x, y = model.features(raw, at), np.asarray(labels, np.float32)
    model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + np.float32(1e-3)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    aside = order[: int(CALIBRATION * len(y))]
    fit = order[len(aside) :]
    share = float(np.clip(y[fit].mean(), 0.02, 0.98))
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    weight = np.sqrt(weight)
    n = x.shape[1]
    p = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    p = [v.astype(np.float32) for v in p]
    m, v2, t = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    z = (x - model.centre) / model.scale
    for _ in range(EPOCHS):
        for cut in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            t += 1
            a = z[cut] @ p[0] + p[1]
            h = np.maximum(a, 0)
            out = np.clip((h @ p[2] + p[3]).ravel(), -30, 30)
            d = ((1 / (1 + np.exp(-out)) - y[cut]) * weight[cut] / max(1, len(cut)))[:, None].astype(np.float32)
            back = d @ p[2].T * (a > 0)
            grads = [z[cut].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], d.sum(axis=0)]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v2[i] = 0.999 * v2[i] + 0.001 * g * g
                p[i] -= (RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v2[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    model.layers = p
    if len(aside):
        logits = model.logits(x[aside]).astype(np.float64)
        grid = np.geomspace(0.25, 16, 49)
        loss = [np.logaddexp(0, np.where(y[aside] > 0.5, -1, 1) * logits / g).mean() for g in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", training_docs: int = TRAINING_DOCS) -> DataFrame:
    """Per row of ``docs``: (``id_col``, held_out, score, predicted).

    The model is fitted on ``training_docs`` labelled documents at most, none held out, taken
    whole until ``sampling.SAMPLE_BYTES`` are, and on one of each label at least; a document with several labels has their mean, halves
    as 1.  Cases: a null or empty text has a score as any other; a very long text is scored whole,
    as a pass of its own; without labelled documents, or with labels of one kind, the score is
    the share of that kind (0.5 without any); a score of 0.5 is predicted as 1; a null id is not
    held out and not learnt from; rows of one id are scored by their own text, and the text of
    the smallest hash is learnt from; repeated rows are scored alike; an empty table gives no
    row; further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    own = docs.select(F.col(id_col).alias("id"), F.struct(F.xxhash64(text_col).alias("text_hash"), sampling.size_of(text_col)).alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    known = saved(marked.where(~sampling.held_out("id")).join(own, "id").select("id", "label", "text.*"))
    chosen = saved(sampling.sample_by_hash(known, "label", training_docs))
    keys = saved(sampling.within_bytes(chosen, "label", sampling.SAMPLE_BYTES, each=False).drop("size", "place"))
    rows = sampling.texts_of(docs, keys, id_col, text_col).select(F.coalesce("text", F.lit("")).alias("text"), "label").orderBy("text", "label").collect()
    texts, y = [r["text"] for r in rows], [r["label"] for r in rows]
    constant = float(np.mean(y)) if y else 0.5
    model = spark.sparkContext.broadcast(train(texts, np.array(y)) if 0 < constant < 1 and len(y) > 1 else None)

    def run(batches):
        m = model.value
        for batch in batches:
            for first, stop, raw, at in spans.passes(batch.column(2)):
                score = np.full(stop - first, constant) if m is None else m.score(raw, at)
                part = batch.slice(first, stop - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), sampling.held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
