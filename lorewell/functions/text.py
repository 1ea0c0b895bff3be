"""Text functions over columns: cleaning, comparable forms, terms, zones, licences, intents.

All are built-in expressions, so that they stay inside code generation.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters, and markers of chat templates, which read as blanks.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}]"
MARKERS = r"(?i)(<\|[^|>]{0,40}\|>|<\s*/?\s*(s|im_start|im_end|system|user|assistant|tool)\s*>|\[/?\s*(INST|SYS|/?s)\s*\]|#{2,}\s*(system|user|assistant|human|ai)\b)"
# Characters that differ in layout only, and what they read as ("" where dropped).
FOLD_FROM = "‘’“”–— ­​‌‍‎‏﻿"
FOLD_TO = "''\"\"-- "


def clean(text: Column, max_len: int = 0) -> Column:
    """Control characters and chat markers to blanks, white space collapsed, cut at max_len with an ellipsis."""
    raw = F.coalesce(text, F.lit(""))
    s = F.regexp_replace(F.regexp_replace(raw, CONTROL, " "), MARKERS, " ")
    s = F.regexp_replace(s, r"[ \t\f\x0b]+", " ")
    s = F.regexp_replace(s, r"\s*\n\s*", "\n")
    # Most short texts have nothing that any of these touches.
    s = F.btrim(F.when(raw.rlike(r"[\x00-\x1f\x7f-\x9f<\[#]|  "), s).otherwise(raw), F.lit(" \t\n\r\f\u000b"))
    return F.when(F.char_length(s) > max_len, F.concat(F.rtrim(F.substring(s, 1, max_len)), F.lit("…"))).otherwise(s) if max_len else s


# By rule: lower-case characters whose case folds to another character, and to several.
_FOLDS = {c: f for i in range(0x80, 0xFFFF) if not 0xD800 <= i < 0xE000 and (c := chr(i)).lower() == c and (f := c.casefold()) != c}
_ONE, _MANY = {c: f for c, f in _FOLDS.items() if len(f) == 1}, {c: f for c, f in _FOLDS.items() if len(f) > 1}


def _ascii(text: Column) -> Column:
    return F.char_length(text) == F.octet_length(text)


def casefold(text: Column) -> Column:
    """The text with all case folded: lower-cased, ß as ss, ς as σ.

    ASCII texts are lower-cased; those of Latin letters need ß replaced; the others take each fold.
    """
    s = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    one = F.translate(s, "".join(_ONE), "".join(_ONE.values()))
    every = reduce(lambda out, x: F.replace(out, F.lit(x[0]), F.lit(x[1])), _MANY.items(), one)
    return F.when(_ascii(text), F.lower(text)).when(s.rlike(r"[^\x00-\xB4\xB6-\xFF]"), every).otherwise(s)


def norm(text: Column) -> Column:
    """The comparable form of a text: quotes and dashes folded, white space collapsed, case folded."""
    raw = F.coalesce(text, F.lit(""))
    # All of these characters but two are in one block, which most texts have none of.
    s = F.when(~_ascii(raw) & raw.rlike(r"[\xA0\xAD\u2000-\u206F\uFEFF]"), F.translate(raw, FOLD_FROM, FOLD_TO)).otherwise(raw)
    return casefold(F.btrim(F.regexp_replace(s, r"[\s\x0b]+", " ")))


def short_hash(*parts: Column) -> Column:
    """The first 20 hex digits of a SHA-1 over parts with NULs between."""
    return F.substring(F.sha1(F.concat_ws("\u0000", *parts)), 1, 20)


def text_hash(text: Column) -> Column:
    return short_hash(norm(text))


def chunk_id(path: Column, section: Column, text: Column) -> Column:
    return short_hash(path, section, text)


def est_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4).cast("int"))


def terms(text: Column, longer_than: int = 2) -> Column:
    """The distinct lower-cased words of more characters than that, in order of first use."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(words, lambda w: F.char_length(w) > longer_than))


def ascii_terms(text: Column, longer_than: int = 0) -> Column:
    """The distinct runs of [a-z0-9] of the lower-cased text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: F.char_length(w) > longer_than))


def stem(word: Column) -> Column:
    """A cheap singular: parties to party, boxes to box, dogs to dog."""
    n = F.char_length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y")))
        .when((n > 4) & word.rlike("[sxzo]es$"), F.left(word, n - 2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1))
        .otherwise(word)
    )


def search_terms(text: Column, most: int = 64) -> Column:
    """The words of a free-text query, without operator characters, ``most`` at most."""
    words = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r'["*:^()]', " "), r"[^\p{L}\p{N}_]+")
    return F.slice(F.filter(words, lambda w: w != ""), 1, most)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def concept(uri: Column) -> Column:
    """/c/en/some_term/n to "some term"."""
    return F.replace(F.get(F.split(uri, "/"), F.lit(3)), F.lit("_"), F.lit(" "))


# Headings of parts that hold no content, by zone.
HEADINGS = {
    "references": ["references", "bibliography", "works cited", "literature cited", "citations", "notes and references", "further reading", "reference list"],
    "toc": ["contents", "table of contents", "list of contents"],
    "index": ["index", "subject index", "author index", "name index"],
    "boilerplate": ["copyright", "imprint", "colophon", "acknowledgements", "acknowledgments", "about the author", "about the authors", "list of figures", "list of tables", "list of illustrations", "list of abbreviations", "dedication", "publisher's note", "publishers note"],
}
# Shapes of lines.
YEAR = r"\(?(?:19|20)\d{2}[a-z]?\)?"
CITED = r"(?i)\bet al\.|\bdoi\b|doi:|\bpp?\.\s*\d|\bvol\.\s*\d|\bno\.\s*\d|^\s*\[\d{1,3}\]|^\s*\d{1,3}\.\s+[A-Z]"
LEADER = r"\.{3,}\s*\d{1,4}\s*$"
PAGE_NUMBER = r"\s\d{1,4}\s*$"
INDEX_LINE = r"^\S.{0,60}?,\s*\d{1,4}([,–-]\s*\d{1,4})*\s*$"
IMPRINT = r"(?i)\bisbn\b|all rights reserved|no part of this (?:publication|book)|printed in|©\s*(?:19|20)\d{2}|copyright ©"
CODE = r"[;{}]\s*$|^\s*[}{]|^\s*(?:def|class|import|from|return|if|elif|else|for|while|function|const|let|var|public|private|static|void|int|fn|impl|pub|package|#include|struct|enum|try|except|catch)\b|=>|->|:=|\|\||&&|</\w+>|^\s*[\w.]+\([^)]*\)\s*[;{]?\s*$|^\s*(?:\$|>>>|#\s*!)"
SENTENCE_END = r"""[.!?]["')\]]?\s*$"""


def last_heading(section: Column) -> Column:
    last = F.element_at(F.split(F.coalesce(section, F.lit("")), ">"), -1)
    return F.btrim(F.regexp_replace(F.lower(F.btrim(F.regexp_replace(last, r"^[\s0-9.:—-]+", ""))), "[^a-z' ]", ""))


def zone(section: Column, text: Column) -> Column:
    """references, toc, index, boilerplate, code or body: by heading, else by the shapes of the lines."""
    head, whole = last_heading(section), F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\u000b")) != "")
    n = F.size(lines)
    having = lambda test: F.size(F.filter(lines, test))
    commas = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(","), F.lit("")))
    cited = having(lambda x: x.rlike(YEAR) & (x.rlike(CITED) | (commas(x) >= 2)))
    pages, imprints = having(lambda x: x.rlike(PAGE_NUMBER)), F.size(F.regexp_extract_all(whole, F.lit(f"({IMPRINT})"), 1))
    code, prose = having(lambda x: x.rlike(CODE)), having(lambda x: x.rlike(SENTENCE_END))
    length = F.aggregate(lines, F.lit(0), lambda a, x: a + F.char_length(x))
    out = F.when(head.isin(HEADINGS["references"]), "references")
    for name in ("toc", "index", "boilerplate"):
        out = out.when(head.isin(HEADINGS[name]), name)
    return (
        out.when((n < 5) & (imprints >= 2), "boilerplate")
        .when(n < 5, "body")
        .when((n >= 6) & (cited >= 0.4 * n), "references")
        .when(having(lambda x: x.rlike(LEADER)) >= 0.3 * n, "toc")
        .when((n >= 8) & (pages >= 0.6 * n) & (length < 60 * n), "toc")
        .when((n >= 8) & (having(lambda x: x.rlike(INDEX_LINE)) >= 0.5 * n), "index")
        .when((imprints >= 2) & (F.char_length(whole) < 2000), "boilerplate")
        .when((code >= 0.4 * n) & (code > prose), "code")
        .otherwise("body")
    )


# Permissions and conditions, and what each known licence says of them (None: unknown).
PERMISSIONS, CONDITIONS = ("redistribute", "derivatives", "commercial"), ("attribution", "share_alike")
LICENCES = {
    "CC0-1.0": (True, True, True, False, False),
    "public-domain": (True, True, True, False, False),
    "CC-BY-4.0": (True, True, True, True, False),
    "CC-BY-SA-4.0": (True, True, True, True, True),
    "CC-BY-ND-4.0": (True, False, True, True, False),
    "CC-BY-NC-4.0": (True, True, False, True, False),
    "CC-BY-NC-SA-4.0": (True, True, False, True, True),
    "CC-BY-NC-ND-4.0": (True, False, False, True, False),
    "MIT": (True, True, True, True, False),
    "Apache-2.0": (True, True, True, True, False),
    "BSD-3-Clause": (True, True, True, True, False),
    "GPL-3.0-only": (True, True, True, True, True),
    "OGL-3.0": (True, True, True, True, False),
    "proprietary": (False, False, False, False, False),
    "all-rights-reserved": (False, False, False, False, False),
    "unknown": (None, None, None, None, None),
}
# Other names of licences.
LICENCE_NAMES = {
    "cc0": "CC0-1.0", "cc-0": "CC0-1.0", "publicdomain": "public-domain",
    "pd": "public-domain", "cc-by": "CC-BY-4.0", "cc-by-sa": "CC-BY-SA-4.0",
    "cc-by-nd": "CC-BY-ND-4.0", "cc-by-nc": "CC-BY-NC-4.0",
    "cc-by-nc-sa": "CC-BY-NC-SA-4.0", "cc-by-nc-nd": "CC-BY-NC-ND-4.0",
    "apache": "Apache-2.0", "apache-2": "Apache-2.0", "gpl": "GPL-3.0-only",
    "gpl-3.0": "GPL-3.0-only", "gplv3": "GPL-3.0-only", "bsd": "BSD-3-Clause",
    "arr": "all-rights-reserved", "copyright": "all-rights-reserved",
    "proprietary": "proprietary", "none": "unknown", "": "unknown",
}
# How texts state a licence and its holder, and the clauses that end a holder's name.
SPDX_TAG = r"SPDX-License-Identifier:\s*([A-Za-z0-9.\-+]+)"
CC_ADDRESS = r"(?i)creativecommons\.org/(?:licenses/(by(?:-nc)?(?:-nd|-sa)?)/(\d\.\d)|publicdomain/(zero|mark))"
COPYRIGHT = r"(?i)(?:©|\(c\)|copyright)\s*(?:©\s*)?(?:(\d{4})(?:\s*[-–]\s*\d{4})?)?\s*(?:by\s+)?([A-Z][A-Za-z0-9.,&'’\- ]{2,70})"
RIGHTS_CLAUSE = r"(?i)(?:\.\s|\s+(?:all rights|is\s+licensed|licensed|under|released|published|\d{4})).*$"
RESERVED, PUBLIC_DOMAIN = r"(?i)\ball rights reserved\b", r"(?i)\bpublic domain\b"
LICENCE_HEAD, LICENCE_TAIL = 20000, 4000


def licence(name: Column) -> Column:
    """The known id of a licence name: as it is, by another name, or by its Creative Commons parts; null reads as unknown."""
    s = F.btrim(F.coalesce(name, F.lit("")))
    low = F.lower(s)
    parts = r"^cc-(by(?:-nc)?(?:-nd|-sa)?)-?([0-9]\.[0-9])?"
    kind, version = F.regexp_extract(low, parts, 1), F.regexp_extract(low, parts, 2)
    exact = F.concat(F.lit("CC-"), F.upper(kind), F.lit("-"), F.when(version == "", "4.0").otherwise(version))
    base = F.concat(F.lit("CC-"), F.upper(kind), F.lit("-4.0"))
    known, other = list(LICENCES), F.create_map(*[F.lit(x) for kv in LICENCE_NAMES.items() for x in kv])
    named = F.try_element_at(other, low)
    return F.when(s.isin(known), s).when(named.isNotNull(), named).when((kind != "") & exact.isin(known), exact).when((kind != "") & base.isin(known), base).otherwise("unknown")


def licence_flag(name: Column, flag: str) -> Column:
    """A permission or condition of a licence: true, false, or null where it is unknown."""
    place = (*PERMISSIONS, *CONDITIONS).index(flag)
    table = F.create_map(*[x for k, flags in LICENCES.items() for x in (F.lit(k), F.lit(flags[place]).cast("boolean"))])
    return F.try_element_at(table, licence(name))


def detect_licence(text: Column) -> Column:
    """(licence, holder) of a text: by SPDX tag near either end, Creative Commons address, public domain, or all rights reserved.

    The holder is what follows a copyright sign, up to a clause about rights.
    """
    whole = F.coalesce(text, F.lit(""))
    head = F.substring(whole, 1, LICENCE_HEAD)
    first = F.regexp_extract(head, SPDX_TAG, 1)
    tag = F.when(first != "", first).otherwise(F.regexp_extract(F.right(whole, F.lit(LICENCE_TAIL)), SPDX_TAG, 1))
    kind, version, zero = (F.regexp_extract(whole, CC_ADDRESS, i) for i in (1, 2, 3))
    found = (
        F.when(tag != "", licence(tag))
        .when(kind != "", licence(F.concat(F.lit("CC-"), F.upper(kind), F.lit("-"), version)))
        .when(F.lower(zero) == "zero", "CC0-1.0")
        .when(F.lower(zero) == "mark", "public-domain")
        .when(head.rlike(PUBLIC_DOMAIN), "public-domain")
        .when(head.rlike(RESERVED), "all-rights-reserved")
    )
    trim = lambda c: F.btrim(c, F.lit(" .,-"))
    holder = trim(F.regexp_replace(trim(F.regexp_extract(head, COPYRIGHT, 2)), RIGHTS_CLAUSE, ""))
    return F.struct(found.alias("licence"), F.when(F.char_length(holder) >= 2, holder).alias("holder"))


# The kinds of knowledge that a source may hold.
REGIMES = ("empirical", "conventional", "fictional", "interpretive", "historical")


def regime_for_path(path: Column, rules: dict[str, str]) -> Column:
    """The regime of the first rule that fits a path, or null: a bare name is a segment, a glob is over the whole path."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(None).cast("string")
    for rule, regime in reversed(rules.items()):
        if regime not in REGIMES:
            continue
        key = rule.lower()
        glob = p.rlike("^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in key) + "$")
        fits = F.array_contains(F.filter(F.split(p, "/"), lambda x: x != ""), key) | glob
        out = F.when(fits, F.lit(regime)).otherwise(out)
    return out


def card_text(title: Column, goal: Column, lists: list[Column], criteria: Column, label: Column) -> Column:
    """What a card is found by: title, goal, its lists of words, the values of its criteria, and its concept's label.

    criteria: a struct of required, supportive and exclusion (arrays with value), threshold, and
    differentials (an array with condition).
    """
    values = [F.transform(criteria[k], lambda x: x["value"]) for k in ("required", "supportive", "exclusion")]
    parts = [F.array(title, goal), *lists, *values, F.array(criteria["threshold"]), F.transform(criteria["differentials"], lambda x: x["condition"]), F.array(label)]
    every = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))
    return F.array_join(F.filter(every, lambda x: x.isNotNull() & (x != "")), " ")


# The ordered cues of intents are in the conditions below.
def intent(question: Column) -> Column:
    """how, what_if, why_diag, why_mech, who, where, taxonomy, which or what, by ordered cues."""
    q = F.lower(F.btrim(F.coalesce(question, F.lit(""))))
    return (
        F.when(q.rlike("^(how do|how to|how can|how should|steps to)"), "how")
        .when(q.contains("what if") | q.startswith("what would happen"), "what_if")
        .when(q.rlike("^(what causes|what could cause|what might cause|why might|why would|what could explain|what's causing)") | q.contains("causes of") | q.contains("differential"), "why_diag")
        .when(q.rlike("^(why|how does|how is)"), "why_mech")
        .when(q.startswith("who"), "who")
        .when(q.startswith("where"), "where")
        .when(q.rlike("what kind|what type|is a kind of"), "taxonomy")
        .when(q.startswith("which"), "which")
        .otherwise("what")
    )


# Ordered cues of speech acts, and how sure each is.
SPEECH_ACTS = (
    ("comparison", 0.8, r"\b(vs|versus)\b|\bwhich (?:is|one|would).{0,30}\b(better|best|prefer|choose|rather)\b|\bcompare\b|\b(better|preferable) than\b|\b\w+ or \w+\s*\?"),
    ("counterfactual_omit", 0.85, r"\bwhat if\b.{0,40}\b(did ?n'?t|do ?n'?t|does ?n'?t|had ?n'?t|have ?n'?t|were ?n'?t|not|without|skip|skipp?ed|omit|fail(?:ed)? to|stop(?:ped)?|no longer|never)\b|\bif (?:i|we|you|he|she|they) (?:did ?n'?t|had ?n'?t|do ?n'?t|stop|skip|never)\b|\bwithout (?:giving|doing|using|taking)\b"),
    ("feasibility", 0.85, r"\b(can|could|may|might|should|shall) (?:i|we|you|one)\b|\bis it (?:safe|ok|okay|wise|advisable|appropriate|acceptable|possible|alright|fine|reasonable) to\b|\bare (?:we|you) (?:able|allowed|supposed|meant|ok) to\b|\bam i (?:allowed|able|supposed|meant|ok) to\b|\bdo (?:i|we) (?:need|have) to\b|\bis it (?:ruled out|incompatible|inadvisable)\b"),
    ("hypothetical", 0.8, r"\bwhat if\b|\bwhat happens if\b|\bwhat would happen\b|\bsuppose\b|\bif i (?:do|give|take|use|add|try|apply|start)\b|\bwhat about (?:if|when)\b"),
    ("diagnostic", 0.8, r"\bwhy\b|\bwhat'?s causing\b|\bwhat is causing\b|\b(?:the )?(?:cause|reason|aetiology|etiology) (?:of|for|behind)\b|\bwhat'?s (?:behind|driving|going on)\b|\bwhat could (?:be )?(?:cause|explain)\b|\bdifferential\b"),
    ("in_progress", 0.75, r"\b(?:now|currently|right now)\b.{0,12}\bi'?m?\b|\bi'?m (?:about to|currently|now|in the (?:middle|process) of|going to|trying to)\b|\b(?:i'?m|we'?re|i am|we are) \w+ing\b|\band now (?:i|we)\b|\bat this (?:point|stage)\b"),
)
QUESTION = r"\b(what|how|which|who|whom|whose|where|when|why)\b"
NARRATOR = r"^\s*(?:we|he|she|they|it|i|my \w+|the \w+)\b"
NARRATION = r"\b(had|has|have|was|were|is|are|did|gave|took|developed|presented|showed|shows|presents|became|got|felt|started|noticed|complained|reported|underwent|received|has been|turned)\b"


def speech_act(text: Column) -> Column:
    """(act, confidence) of an utterance: the first cue that it has, else a narration, a question, or ambiguous."""
    q = F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    told = lambda act, sure: F.struct(F.lit(act).alias("act"), F.lit(sure).alias("confidence"))
    out = F.when(q == "", told("ambiguous", 0.0))
    for act, sure, cue in SPEECH_ACTS:
        out = out.when(q.rlike(cue), told(act, sure))
    asks = q.endswith("?") | q.rlike(QUESTION)
    return out.when(~asks & q.rlike(NARRATOR) & q.rlike(NARRATION), told("observation", 0.7)).when(asks, told("factual", 0.6)).otherwise(told("ambiguous", 0.3))
