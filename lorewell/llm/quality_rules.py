"""Quality rules, line first: failing lines go, then documents that lost too much text.

All counts are made from the bytes of many documents at once (:mod:`lorewell.llm.spans`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lorewell.llm import spans

SYMBOLS = b"#*$%&|<>"
#: Characters that end a sentence or a clause.
CLOSING = ".!?:;,\"')]»”’…。！？；：、）」』"
#: Lower-cased phrases of page furniture, by language (A-Z alone are lower-cased in a text).
FURNITURE_PHRASES = {
    "en": ("javascript", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "subscribe to our", "sign up for", "click here", "lorem ipsum", "skip to content"),
    "fr": ("politique de confidentialité", "tous droits réservés", "conditions d'utilisation", "cliquez ici", "abonnez-vous à", "aller au contenu", "mentions légales"),
    "de": ("datenschutzerklärung", "alle rechte vorbehalten", "nutzungsbedingungen", "klicken sie hier", "newsletter abonnieren", "zum inhalt springen"),
    "es": ("política de privacidad", "todos los derechos reservados", "términos de uso", "haga clic aquí", "suscríbete a", "saltar al contenido", "aviso legal"),
}
FURNITURE = tuple(p.encode() for phrases in FURNITURE_PHRASES.values() for p in phrases)
_U = np.uint64


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the document's verdict."""

    min_words: int = 10
    max_repeat_percent: int = 20
    #: A line with more symbols than this share of its words is navigation or noise.
    symbols_per_word: float = 0.3
    #: A line of so many letters of which so large a share are capitals is shouting.
    capital_letters: int = 12
    capital_share: float = 0.7
    #: A line of fewer words must end with punctuation.
    unclosed_words: int = 4
    #: A longer line than this is not furniture for holding a phrase of it.
    furniture_words: int = 40
    #: A document that keeps less than this share of its word characters is rejected.
    kept_share: float = 0.5


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


_SYMBOL, _CLOSING = _table(SYMBOLS), _table("".join(c for c in CLOSING if c.isascii()).encode())
#: Those of more bytes, as numbers, by their size.
_WIDE = {n: np.array([int.from_bytes(b, "big") for c in CLOSING if len(b := c.encode()) == n], np.int64) for n in (2, 3)}
_CAPITAL = _table(bytes(range(65, 91)))
_LETTER = _CAPITAL | _table(bytes(range(97, 123)))


def _closed(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Is the character before each end (with a word there) one of CLOSING?"""
    out = _CLOSING[raw[ends - 1]]
    wide = np.flatnonzero(raw[ends - 1] >= 128)
    for n, members in _WIDE.items():
        at = wide[ends[wide] >= n]
        code = np.zeros(len(at), np.int64)
        for k in range(n, 0, -1):
            code = code << 8 | raw[ends[at] - k]
        out[at] |= np.isin(code, members)
    return out


def measure(raw: np.ndarray, at: np.ndarray, rules: Rules) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Counts for each document; starts, ends, documents and verdicts of the lines."""
    docs = len(at) - 1
    starts, ends, doc = spans.words(raw, at)
    count = lambda where, weights=None: np.bincount(where, weights=weights, minlength=docs).astype(np.int64)
    runs = lambda marks: np.r_[0, np.cumsum(marks)]
    points = runs((raw & 0xC0) != 0x80)
    chars = points[ends] - points[starts]
    symbols = runs(_SYMBOL[raw])
    out = {"n_words": count(doc), "word_chars": count(doc, chars), "n_symbols": symbols[at[1:]] - symbols[at[:-1]]}

    h = spans.hash_spans(raw, starts, ends)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) >= 5:
        size = len(h) - 4
        g = h[:size].copy()
        for j in range(1, 5):
            g = spans.mix(g * spans._C1 + h[j : size + j])
        where = np.flatnonzero(doc[:size] == doc[4:])
        key = spans.mix(g[where] ^ (doc[where].astype(_U) * spans._C2))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = where[order[np.r_[same, False] | np.r_[False, same]]] if len(where) else where
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 5, -1)
    out["n_repeat_words"] = count(doc[np.cumsum(covered)[:-1] > 0])

    l0, l1, owner = spans.lines(raw, at)
    w0, w1 = np.searchsorted(starts, l0), np.searchsorted(starts, l1)
    n = w1 - w0
    full = n > 0
    key = spans.mix(spans.hash_spans(raw, l0[full], l1[full]) ^ (owner[full].astype(_U) * spans._C2))
    out["n_dup_lines"] = count(owner[full]) - count(owner[full][np.unique(key, return_index=True)[1]])

    capitals, letters, sums = runs(_CAPITAL[raw]), runs(_LETTER[raw]), runs(chars)
    many = letters[l1] - letters[l0]
    failed = symbols[l1] - symbols[l0] > rules.symbols_per_word * n
    failed |= (many >= rules.capital_letters) & (capitals[l1] - capitals[l0] > rules.capital_share * many)
    closed = np.ones(len(n), bool)
    closed[full] = _closed(raw, ends[w1[full] - 1])
    failed |= (n < rules.unclosed_words) & ~closed
    low = spans.LOWER[raw].tobytes()
    for phrase in FURNITURE:
        i = low.find(phrase)
        while i >= 0:
            k = int(np.searchsorted(l0, i, "right")) - 1
            failed[k] |= i + len(phrase) <= l1[k] and n[k] <= rules.furniture_words
            i = low.find(phrase, i + 1)
    failed &= full
    line_chars = sums[w1] - sums[w0]
    out["n_lines"], out["n_failed_lines"] = count(owner), count(owner[failed])
    out["kept_chars"] = count(owner[~failed], line_chars[~failed])
    return out, (l0, l1, owner, failed)


def verdicts(c: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from a document's counts."""
    failed = (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"])
    return failed, ~failed & (c["kept_chars"] >= rules.kept_share * c["word_chars"])


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_failed_lines", "kept_chars")


def quality_report(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (``id_col``, counts, base_failed, kept).

    The base fails a document of few words or of many words in repeated 5-word windows.
    Else its lines are judged (symbols, capitals, missing punctuation, page furniture) and
    it is kept if the lines that pass hold ``kept_share`` of its word characters (as many is
    enough).  Cases: a null or blank text has no words and fails; a very long text is a pass of
    its own, in memory that grows with it alone; a null id passes through; repeated rows are
    judged alike; an empty table gives no row; further columns are ignored, whatever their names.
    """
    rules = rules or Rules()

    def run(batches):
        for batch in batches:
            for first, stop, raw, at in spans.passes(batch.column(1)):
                c, _ = measure(raw, at, rules)
                failed, kept = verdicts(c, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), *[pa.array(c[k], pa.int64()) for k in _COUNTS], pa.array(failed), pa.array(kept), *[pa.array(c[k], pa.int64()) for k in _MORE]], names=["id", *_COUNTS, "base_failed", "kept", *_MORE])

    kind = docs.schema[id_col].dataType.simpleString()
    longs = lambda names: ", ".join(f"{k} long" for k in names)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {longs(_COUNTS)}, base_failed boolean, kept boolean, {longs(_MORE)}").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, rules: Rules | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, without the lines that failed.

    A column n_chars of whole numbers follows the text; one of another type is passed through,
    as are all further columns.  Cases as in :func:`quality_report`.
    """
    rules = rules or Rules()
    names = docs.columns
    at_text = names.index(text_col)
    sized = "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, IntegralType)

    def run(batches):
        for batch in batches:
            for first, stop, raw, at in spans.passes(batch.column(at_text)):
                c, (l0, l1, owner, failed) = measure(raw, at, rules)
                _, kept = verdicts(c, rules)
                rows = np.flatnonzero(kept)
                table = batch.slice(first, stop - first).take(pa.array(rows))
                texts = table.column(at_text).to_pylist()
                cuts = np.searchsorted(owner, np.arange(stop - first + 1))
                data = raw.tobytes()
                for k, i in enumerate(rows):
                    own = slice(cuts[i], cuts[i + 1])
                    if failed[own].any():
                        texts[k] = b"\n".join(data[a:b] for a, b, bad in zip(l0[own], l1[own], failed[own], strict=True) if not bad).decode()
                columns = list(table.columns)
                columns[at_text] = pa.array(texts, pa.string())
                if sized:
                    columns[names.index("n_chars")] = pa.array([len(x) for x in texts], table.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
