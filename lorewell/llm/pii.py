"""Personal data in texts: exact patterns, and a conditional random field for what they miss.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers.  The field
(:mod:`lorewell.llm.pii_crf`) reads every line; it adds written-out e-mail addresses, local
phone numbers, names of people, identity numbers and secrets, where no pattern's span is.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import pii_crf, spans

BASE_KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate((*BASE_KINDS, "person", "id", "secret"))}

# Possessive quantifiers and a start at the head of a run: the leftmost matches of the plain
# patterns, found in time linear in the text.
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": regex.compile(rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": regex.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": regex.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = regex.compile(r"[^0-9]+")

def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _holds(kind: str, text: str) -> bool:
    """Does a pattern's match pass the checks of its kind?"""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in text.split(".")))
    digits = _DIGIT.sub("", text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start and kind; a match that fails is dropped."""
    out = []
    for kind, pattern in _PATTERNS.items():
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if _holds(kind, m.group())]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def field_spans(raw: np.ndarray, at: np.ndarray, field: pii_crf.Field) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) in code points of what the field finds in each text, in order."""
    tokens = pii_crf.read(raw, at)
    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    out: list[list] = [[] for _ in range(len(at) - 1)]
    for first, stop, kind in field.find(tokens):
        a, b = tokens.start[first], tokens.end[stop - 1]
        doc = int(np.searchsorted(at, a, "right")) - 1
        out[doc].append((int(points[a] - points[at[doc]]), int(points[b] - points[at[doc]]), kind))
    return out


def without_overlaps(more: list[tuple[int, int, str]], own: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans of ``more`` that no span of ``own`` (in order) overlaps."""
    if not own:
        return more
    starts, reach = [a for a, _, _ in own], []
    for _, b, _ in own:
        reach.append(max(b, reach[-1]) if reach else b)
    return [s for s in more if not (i := bisect_left(starts, s[1])) or reach[i - 1] <= s[0]]


def join_spans(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (``id_col``, n_email, n_ip, n_card, n_phone, n_base, n_spans, base, spans).

    ``base`` lists the patterns' spans as kind:start:end in code points, joined by commas, by
    start and then kind; ``spans`` lists all of them with those the field adds where no base
    span overlaps.  n_base and n_spans count these; the other counts are of base spans.  Cases:
    a null or empty text has none; a very long text or line is read in linear time, as a pass
    of its own; equal paths of the field go to the first label in order; a null id passes
    through; repeated rows are alike; an empty table gives no row; further columns are
    ignored, whatever their names.
    """
    field = docs.sparkSession.sparkContext.broadcast(pii_crf.trained())

    def run(batches):
        for batch in batches:
            for first, stop, raw, at in spans.passes(batch.column(1)):
                n = stop - first
                base: list[list] = [[] for _ in range(n)]
                data = raw.tobytes()
                # Every pattern needs a digit or an @.
                seen = np.r_[0, np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64))]
                for i in np.flatnonzero(seen[at[1:]] > seen[at[:-1]]):
                    base[i] = base_spans(data[at[i] : at[i + 1]].decode())
                every = [own + without_overlaps(more, own) for own, more in zip(base, field_spans(raw, at, field.value), strict=True)]
                count = lambda k: [sum(s[2] == k for s in own) for own in base]  # noqa: E731, B023
                longs = [*map(count, BASE_KINDS), [len(x) for x in base], [len(x) for x in every]]
                strings = [[join_spans(x) for x in both] for both in (base, every)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *[pa.array(x, pa.int64()) for x in longs], *[pa.array(x, pa.string()) for x in strings]], names=["id", *names, "base", "spans"])

    names = [*[f"n_{k}" for k in BASE_KINDS], "n_base", "n_spans"]
    kind = docs.schema[id_col].dataType.simpleString()
    longs = ", ".join(f"{k} long" for k in names)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {longs}, base string, spans string").withColumnRenamed("id", id_col)
