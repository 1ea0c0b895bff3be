"""The Porter stemmer, and forms of letters without their marks, for search indexes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")


# By rule: every letter up to U+1FFF that is one letter and its marks.
_MARKED = {c: p for i in range(0xC0, 0x2000) if (c := chr(i)).isalpha() and len(p := _plain(c)) == 1 and p != c}
MARKED, UNMARKED = "".join(_MARKED), "".join(_MARKED.values())


def unmarked(text: Column) -> Column:
    """The text with letters without their marks: é as e, ñ as n; ASCII texts have none."""
    return F.when(F.char_length(text) == F.octet_length(text), text).otherwise(F.translate(text, MARKED, UNMARKED))


# Endings and what they become, by step of the algorithm.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: The last letters of all endings of all steps.
LAST = frozenset("sdgyel") | {e[-1] for e in (*STEP_2, *STEP_3, *STEP_4)}


def _consonants(word: str) -> str:
    """c or v for each letter: y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = _consonants(word)
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


def _short(word: str) -> bool:
    """Does a word end in consonant, vowel, consonant, the last not w, x or y?"""
    return _consonants(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len) if word.endswith(tuple(endings)) else None


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a lower-cased word, by Porter's algorithm of 1980; words of under three letters stay."""
    if len(word) < 3 or word[-1] not in LAST:
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (end := _longest(w, ("ed", "ing"))) and "v" in _consonants(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _consonants(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if (end := _longest(w, table)) and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    if (end := _longest(w, STEP_4)) and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@F.pandas_udf(ArrayType(StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    """Stems of arrays of words; a worker remembers the words that it has met."""
    return words.map(lambda own: None if own is None else [porter(w) for w in own])
