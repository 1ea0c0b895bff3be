"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to ORDER bytes.  A byte's code length is taken from
the longest context that has seen it; every longer context that has not adds the cost of an
escape (method C: as many escapes as different bytes seen).  The statistics are frozen:
the code lengths of all languages are laid out in one table per order when the model is
made, and scoring a text looks each position up by its exact bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm import sampling, spans
from lorewell.llm.graph import saved

#: Bytes of context.
ORDER = 4
#: Training documents of each language and of all languages, at most: those of the smallest hash of the id.
DOCS_PER_LANGUAGE, TRAINING_DOCS = 300, 30_000
#: Bits of difference in code length that a factor e in the score stands for.
TEMPERATURE = 8.0
UNKNOWN = "und"
#: Bytes of text that one pass scores: each has a row of code lengths, one a language.
PASS_BYTES = 1 << 18
_U = np.uint64

#: A-Z lower-cased, white space to a blank, digits to 0: case, layout and numbers tell no language.
FOLD = spans.LOWER.copy()
FOLD[spans.SPACE] = 32
FOLD[48:58] = 48


class Table:
    """Whole numbers to rows of values, by open addressing; row 0 stands for absent keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, 2 * len(keys))))))
        self.keys = np.full(1 << self.bits, ~_U(0))
        self.rows = np.zeros(1 << self.bits, np.int32)
        self.values = np.vstack([np.zeros((1, values.shape[1]), np.float32), values.astype(np.float32)])
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(todo):
            free = self.rows[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.rows[slot[put]] = keys[todo[put]], todo[put] + 1
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, 0 where it is absent."""
        slot = self._slot(keys)
        hit = self.keys[slot] == keys
        out = np.where(hit, self.rows[slot], 0)
        todo = np.flatnonzero(~hit & (self.rows[slot] != 0))
        while len(todo):
            at = slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.rows[at[hit]]
            todo = todo[~hit & (self.rows[at] != 0)]
        return out


def grams(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``order`` bytes before it (blanks before a text) as a number; offsets of the texts."""
    docs = len(at) - 1
    wide = np.full(len(raw) + order * docs, 32, np.uint8)
    wide[np.arange(len(raw)) + order * (np.repeat(np.arange(docs), np.diff(at)) + 1)] = FOLD[raw]
    keys = np.zeros(len(wide), _U)
    for back in range(order + 1):
        keys[back:] |= wide[: len(wide) - back].astype(_U) << _U(8 * back)
    real = np.ones(len(wide), bool)
    real[(at[:-1] + order * np.arange(docs))[:, None] + np.arange(order)] = False
    return keys[real], at


def low(keys: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of each number."""
    return keys & _U((1 << (8 * n)) - 1)


@dataclass
class Model:
    languages: list[str]
    #: For each order from ORDER down to 0: code lengths by context and byte, escape costs by context.
    orders: list[tuple[Table, Table]]

    def bits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length in bits of each text in each language."""
        keys, at = grams(raw, at, len(self.orders) - 1)
        total = np.zeros((len(keys), len(self.languages)), np.float32)
        todo = np.arange(len(keys))
        for i, (codes, escapes) in enumerate(self.orders):
            order = len(self.orders) - 1 - i
            own = low(keys if i == 0 else keys[todo], order + 1)
            rows = codes.find(own)
            if i == 0:
                total = codes.values[rows]
            else:
                total[todo] += codes.values[rows]
            missing = rows == 0
            todo, own = todo[missing], own[missing]
            if not len(todo):
                break
            total[todo] += escapes.values[escapes.find(own >> _U(8))]
        total[todo] += 8
        sums = np.zeros((len(at) - 1, len(self.languages)))
        full = np.flatnonzero(at[1:] > at[:-1])
        if len(full):
            sums[full] = np.add.reduceat(total, at[:-1][full], axis=0, dtype=np.float64)
        return sums


def train(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """A model of some texts in each language."""
    languages = sorted(texts)
    seen = {}
    for k in languages:
        raw, at = spans.column_bytes(pa.array(texts[k], pa.string()))
        seen[k] = grams(raw, at, order)[0]
    orders, lower, lower_keys = [], None, None
    for n in range(order + 1):
        counted = [np.unique(low(seen[k], n + 1), return_counts=True) for k in languages]
        keys = np.unique(np.concatenate([c[0] for c in counted]))
        contexts = np.unique(keys >> _U(8))
        where = np.searchsorted(contexts, keys >> _U(8))
        back = np.full((len(keys), len(languages)), 8.0) if lower is None else lower[np.searchsorted(lower_keys, low(keys, n))]
        codes, escapes = np.zeros((len(keys), len(languages))), np.zeros((len(contexts), len(languages)))
        for i, (own, c) in enumerate(counted):
            count = np.zeros(len(keys))
            count[np.searchsorted(keys, own)] = c
            total, kinds = np.bincount(where, count, len(contexts)), np.bincount(where, count > 0, len(contexts))
            known = total > 0
            escapes[known, i] = -np.log2(kinds[known] / (total + kinds)[known])
            codes[:, i] = escapes[where, i] + back[:, i]
            on = count > 0
            codes[on, i] = -np.log2(count[on] / (total + kinds)[where[on]])
        orders.append((Table(keys, codes), Table(contexts, escapes)))
        lower, lower_keys = codes, keys
    return Model(languages, orders[::-1])


def _training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int) -> dict[str, list[str]]:
    """``most`` texts of each language at most, and TRAINING_DOCS in all, by hash of the id, until their bytes are an even share of SAMPLE_BYTES.

    Ids are chosen first, without their texts; tasks send on no more than they may keep.
    """
    usable = docs.where(~sampling.held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keys = usable.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), sampling.size_of(text_col))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text_hash")
    chosen = saved(keys.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= most))
    languages = chosen.select("lang").distinct().count()
    few = chosen.where(F.col("place") <= max(1, TRAINING_DOCS // max(1, languages))).drop("place")
    few = saved(sampling.within_bytes(few, "lang", sampling.SAMPLE_BYTES // max(1, languages), each=True).drop("size"))
    out: dict[str, list[str]] = {}
    for r in sampling.texts_of(docs, few, id_col, text_col).orderBy("lang", "place").toLocalIterator():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def _lettered(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Has each text a letter?"""
    ascii_ = np.r_[0, np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128))]
    out = ascii_[at[1:]] > ascii_[at[:-1]]
    data = raw.tobytes()
    for i in np.flatnonzero(~out & (at[1:] > at[:-1])):
        out[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].decode())
    return out


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """Per row of ``docs``: (``id_col``, held_out, lang_pred, score).

    The model learns from ``docs_per_language`` documents of each language at most that are not
    held out (and from TRAINING_DOCS in all, fewer of each where there are many languages), taken
    whole until ``sampling.SAMPLE_BYTES`` are, and from one text of each at least.  score is the share of the shortest code among
    all, with differences in bits divided by TEMPERATURE.  Cases: a null text, one without a
    letter, or a table without a labelled row gives ``und`` with score 0; a very long text is
    scored whole, as a pass of its own; equal code lengths go to the first language in order;
    repeated rows are scored alike, and equal rows are learnt from as often as they are chosen;
    a null id is not held out and not learnt from; an empty table gives no row; further
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = _training_texts(docs, id_col, text_col, lang_col, docs_per_language)
    model = spark.sparkContext.broadcast(train(texts) if texts else None)

    def run(batches):
        m = model.value
        for batch in batches:
            for first, stop, raw, at in spans.passes(batch.column(2), PASS_BYTES):
                sure = _lettered(raw, at)
                names, score = [UNKNOWN] * (stop - first), np.zeros(stop - first)
                if m is not None and sure.any():
                    bits = m.bits(raw, at)
                    best = bits.argmin(axis=1)
                    with np.errstate(under="ignore"):
                        odds = np.exp(-(bits - bits.min(axis=1, keepdims=True)) * (np.log(2) / TEMPERATURE))
                    score = np.where(sure, 1 / odds.sum(axis=1), 0.0)
                    names = [m.languages[b] if s else UNKNOWN for b, s in zip(best, sure, strict=True)]
                part = batch.slice(first, stop - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score)], names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), sampling.held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
