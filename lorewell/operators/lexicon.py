"""Lexicon matching: normal forms, tokens, a checked compilation, exact and corrected spans of aliases."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import astuple, dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Versions, separator of a stored form, longest input, worth of a corrected token by its edits.
MATCHER_VERSION, NORM_VERSION, TOK_VERSION = "1.0.0", "NORM-1", "TOK-1"
US, MAX_INPUT = "\u001f", 4096
EDIT_WORTH = {1: 0.8, 2: 0.6}
# Edits and prefix of the index of deletions, shortest corrected word, longest that takes one edit alone, most tokens, nodes of an ambiguous form.
EDITS, PREFIX, LEAST_FUZZY, ONE_EDIT, MAX_TOKENS, AMBIGUOUS = 2, 7, 4, 6, 8, 4
# Words that no alias may be without regard to case.
STOP_WORDS = frozenset("a an and are as at be been but by for from had has have he if in is it no not of off on or out over she so than that the then they this to under up was we were with you".split())
APOSTROPHES = "'’"
#: Words whose nearest ones a matcher remembers, and tokens whose forms a process does.
REMEMBERED, FORMS = 400_000, 100_000
#: What most words are nearest to.
_NOTHING: tuple[int, list[str]] = (0, [])
# Letters and numbers are what \w has but for the underscore; \d is category Nd.
_TOKEN = re.compile(r"(?:[^\W_]|['’]|(?<=\d)[.,](?=\d))+")


@lru_cache(maxsize=FORMS)
def norm_token(token: str) -> str:
    """NFKC, case-folded, without a possessive ending and apostrophes."""
    t = unicodedata.normalize("NFKC", token).casefold()
    t = t[:-2] if t[-1:] == "s" and t[-2:-1] in tuple(APOSTROPHES) else t
    return "".join(c for c in t if c not in APOSTROPHES)


def tokenize(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) of runs of letters, numbers and apostrophes; . and , belong to them between two digits."""
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]


def osa(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours being one; no part is edited twice.

    A column of the table of distances is two integers of a bit a row: where it rises and where it falls (Hyyrö 2003).
    """
    # What both begin and end with takes no edits.
    end = min(len(a), len(b))
    i = next((i for i in range(end) if a[i] != b[i]), end)
    j = next((j for j in range(end - i) if a[-1 - j] != b[-1 - j]), end - i)
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last, out = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    rise, fall, kept, before = every, 0, 0, 0
    for y in b:
        at = places.get(y, 0)
        swapped = ((~kept & at) << 1) & before
        kept = (((at & rise) + rise) ^ rise | at | fall | swapped) & every
        right, left = (fall | ~(kept | rise)) & every, kept & rise
        out += bool(right & last) - bool(left & last)
        right = right << 1 | 1
        rise, fall = (left << 1 | ~(kept | right)) & every, right & kept
        before = at
    return out


def deletes(word: str, edits: int = EDITS, prefix: int = PREFIX) -> set[str]:
    out = {word[:prefix]}
    last = out
    for _ in range(edits):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def _letters(word: str) -> int:
    """A bit for each character, by its code modulo 64."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


def _has_letter(word: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in word)


@dataclass(frozen=True)
class Alias:
    """A row of the alias table; norm_seq and n_tokens are of the surface where they are not given."""

    alias_id: int
    node_id: str
    surface: str
    weight: float = 1.0
    case_mode: str = "fold"
    fuzzy_allowed: bool = True
    alias_type: str = "preferred"
    origin: str = "pub"
    derived_from: int | None = None
    status: str = "active"
    norm_seq: str | None = None
    n_tokens: int | None = None

    def forms(self) -> list[str]:
        return [norm_token(t) for t, *_ in tokenize(self.surface)]

    def stored(self) -> tuple[str, int]:
        own = self.forms()
        return US.join(own) if self.norm_seq is None else self.norm_seq, len(own) if self.n_tokens is None else self.n_tokens


def findings(aliases: list[Alias], nodes: set[str] | None = None) -> list[tuple[str, str, int | None]]:
    """(level, code, alias_id) of all active rows.

    EMPTY_NORM: a token without a form.  C1: a form of one or two letters that is not told by
    case or may be corrected.  C2: a stopword that is not told by case.  C3: an unknown node.
    C4: stored forms that are not the surface's (or too many tokens, a weight outside 0 to 1, an
    unknown case mode).  As warnings, AMBIGUOUS_NORM: a form of over AMBIGUOUS nodes, and
    ORIGIN_SHADOW: a form that a published alias of another node has.
    """
    out: list[tuple[str, str, int | None]] = []
    by_form = defaultdict(list)
    for a in sorted((a for a in aliases if a.status == "active"), key=lambda a: a.alias_id):
        own, (seq, n) = a.forms(), a.stored()
        told = a.case_mode in ("exact", "caps")
        checks = {
            "EMPTY_NORM": not all(own),
            "C4": (seq, n) != (US.join(own), len(own)) or not 1 <= n <= MAX_TOKENS or not 0 < a.weight <= 1 or not (told or a.case_mode == "fold"),
            "C1": len(own) == 1 and len(own[0]) <= 2 and not (told and not a.fuzzy_allowed),
            "C2": len(own) == 1 and own[0] in STOP_WORDS and not told,
            "C3": nodes is not None and a.node_id not in nodes,
        }
        out += [("ERROR", code, a.alias_id) for code, bad in checks.items() if bad]
        by_form[seq].append(a)
    for _, group in sorted(by_form.items()):
        if len({a.node_id for a in group}) > AMBIGUOUS:
            out.append(("WARN", "AMBIGUOUS_NORM", None))
        published = {a.node_id for a in group if a.origin == "pub"}
        out += [("WARN", "ORIGIN_SHADOW", a.alias_id) for a in group if a.origin != "pub" and published - {a.node_id}]
    return out


@dataclass(frozen=True)
class Lexicon:
    """Active aliases, and each word of theirs with its id (by UTF-8 order), how many aliases have it, and whether it may be corrected to."""

    version: str
    aliases: tuple[Alias, ...]
    vocabulary: dict[str, tuple[int, int, str]] = field(hash=False)


def compile_lexicon(aliases: list[Alias], nodes: set[str] | None = None) -> tuple[list, Lexicon | None]:
    """(findings, lexicon): None if any finding is an error."""
    found = findings(aliases, nodes)
    if any(level == "ERROR" for level, *_ in found):
        return found, None
    live = sorted((a for a in aliases if a.status == "active"), key=lambda a: a.alias_id)
    rows = [[a.alias_id, a.node_id, a.surface, *a.stored(), a.alias_type, f"{a.weight:.4f}", a.case_mode, int(a.fuzzy_allowed), a.origin, a.derived_from, a.status] for a in live]
    version = hashlib.sha256("\n".join(json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in rows).encode()).hexdigest()
    count, may = Counter(), defaultdict(set)
    for a in live:
        for w in set(a.stored()[0].split(US)):
            count[w] += 1
            may[w].add(a.fuzzy_allowed)
    vocabulary = {}
    for i, w in enumerate(sorted(count, key=str.encode)):
        eligible = len(w) >= LEAST_FUZZY and _has_letter(w)
        vocabulary[w] = (i, count[w], ("targetable" if True in may[w] else "suppressed") if eligible else "none")
    return found, Lexicon(version, tuple(live), vocabulary)


def report(aliases: list[Alias], nodes: set[str] | None = None) -> str:
    """The compile report as canonical JSON."""
    found, lexicon = compile_lexicon(aliases, nodes)
    errors = sum(level == "ERROR" for level, *_ in found)
    counts = {"aliases": sum(a.status == "active" for a in aliases), "errors": errors, "warnings": len(found) - errors, "vocab_size": len(lexicon.vocabulary) if lexicon else 0}
    return json.dumps({"findings": [{"level": a, "code": b, "alias_id": c} for a, b, c in found], "counts": counts}, ensure_ascii=False, separators=(",", ":"))


class Matcher:
    """Spans of a lexicon's aliases in texts: all exact ones by windows of tokens, corrected words where none is exact, leftmost longest."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.by_form: dict[tuple, list[Alias]] = defaultdict(list)
        #: Words by what deletions leave of them, for words that take one edit and for those that take EDITS.
        self.deletes: dict[int, dict[str, set[tuple[str, int, int]]]] = {1: defaultdict(set), EDITS: defaultdict(set)}
        for a in lexicon.aliases:
            self.by_form[tuple(a.stored()[0].split(US))].append(a)
        for w, (_, _, kind) in lexicon.vocabulary.items():
            for most, met in (1, len(w) <= ONE_EDIT + 1), (EDITS, len(w) > ONE_EDIT - EDITS):
                if kind != "none" and met:
                    for d in deletes(w, most):
                        self.deletes[most][d].add((w, len(w), _letters(w)))
        self.by_id = {a.alias_id: a for a in lexicon.aliases}
        #: The numbers of tokens of the forms that begin with a word.
        self.sizes: dict[str, list[int]] = defaultdict(list)
        for form in sorted(self.by_form, key=len):
            if len(form) not in self.sizes[form[0]]:
                self.sizes[form[0]].append(len(form))
        self.remembered: dict[str, tuple[int, list[str]]] = {}

    def _windows(self, forms: list[str | None], surfaces: list[str]) -> dict[tuple[int, int], set[int]]:
        """Aliases by (first token, token after the last), told by case where their rows ask for it; a token without a form is in none."""
        out: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, first in enumerate(forms):
            for n in self.sizes.get(first, ()) if first is not None else ():
                for a in self.by_form.get(tuple(forms[i : i + n]), ()) if i + n <= len(forms) else ():
                    if self._told(a, surfaces[i : i + n]):
                        out[i, i + n].add(a.alias_id)
        return out

    @staticmethod
    def _told(a: Alias, surfaces: list[str]) -> bool:
        if a.case_mode == "exact":
            same = lambda x: unicodedata.normalize("NFKC", x)
            return [same(x) for x in surfaces] == [same(t) for t, *_ in tokenize(a.surface)]
        return a.case_mode == "fold" or not any(unicodedata.category(c) in ("Ll", "Lt") for x in surfaces for c in x)

    def _nearest(self, word: str) -> tuple[int, list[str]]:
        """The fewest edits to words that may be corrected to, within the edits that a word of this length takes, and those words."""
        if word not in self.remembered:
            if len(self.remembered) > REMEMBERED:
                self.remembered.clear()
            most = 1 if len(word) <= ONE_EDIT else EDITS
            size, own = len(word), _letters(word)
            met = set().union(*[held for d in deletes(word, most) if (held := self.deletes[most].get(d))])
            # An edit changes the length by one, and which characters there are by two.
            near = [(d, w) for w, n, x in met if -most <= n - size <= most and (x ^ own).bit_count() <= 2 * most and (d := osa(word, w)) <= most]
            least = min((d for d, _ in near), default=0)
            self.remembered[word] = (least, [w for d, w in near if d == least]) if near else _NOTHING
        return self.remembered[word]

    def read(self, text: str) -> dict:
        """tokens, spans (with all candidates), tokens in none, and flags of corrections that were held back.

        Raises ValueError for a text over MAX_INPUT characters or with lone surrogates.
        """
        if not isinstance(text, str) or any("\ud800" <= c <= "\udfff" for c in text):
            raise ValueError("E_INVALID_INPUT: not a text, or it has lone surrogates")
        if len(text) > MAX_INPUT:
            raise ValueError(f"E_INPUT_TOO_LONG: {len(text)} characters of {MAX_INPUT}")
        vocabulary, by_id = self.lexicon.vocabulary, self.by_id
        found = tokenize(text)
        surfaces, norms = [t for t, *_ in found], [norm_token(t) for t, *_ in found]
        known = [w if w in vocabulary else None for w in norms]
        spans = self._windows(known, surfaces)
        covered = {p for a, b in spans for p in range(a, b)}
        edits: dict[int, int] = {}
        flags = []
        for i, w in enumerate(norms):
            if not w or w in vocabulary or i in covered or len(w) < LEAST_FUZZY or not _has_letter(w):
                continue
            distance, near = self._nearest(w)
            held = [x for x in near if vocabulary[x][2] == "suppressed"]
            if near:
                best = min(held or near, key=lambda x: (-vocabulary[x][1], x))
                if held:
                    flags.append(("token", i, best, distance))
                else:
                    known[i], edits[i] = best, distance
        if edits:
            for where, ids in self._windows(known, surfaces).items():
                spans[where] |= ids
        for (a, b), ids in sorted(spans.items()):
            changed = [p for p in range(a, b) if p in edits]
            barred = {x for x in ids if not by_id[x].fuzzy_allowed} if changed else set()
            if barred and barred == ids:
                first = by_id[min(barred)]
                flags.append(("span", changed[0], first.stored()[0].replace(US, " "), sum(edits[p] for p in changed)))
            spans[a, b] = ids - barred
        scored = {}
        for (a, b), ids in spans.items():
            worth = 1.0
            for p in range(a, b):
                worth *= EDIT_WORTH.get(edits.get(p), 1.0)
            if ids:
                scored[a, b] = sorted(((round(by_id[x].weight * worth, 4), by_id[x]) for x in ids), key=lambda c: (-c[0], c[1].alias_id))
        out, at = [], 0
        for (a, b), own in sorted(scored.items(), key=lambda s: (s[0][0], -s[0][1], -s[1][0][0], s[1][0][1].alias_id)):
            if a >= at:
                out.append((a, b, own))
                at = b
        inside = {p for a, b, _ in out for p in range(a, b)}
        shown = [known[i] if i in edits else w for i, w in enumerate(norms)]
        return {
            "tokens": [(i, t, shown[i], a, b, norms[i] if i in edits else None, edits.get(i, 0)) for i, (t, a, b) in enumerate(found)],
            "spans": [(k, a, b, found[a][1], found[b - 1][2], text[found[a][1] : found[b - 1][2]], " ".join(shown[a:b]), any(p in edits for p in range(a, b)), own) for k, (a, b, own) in enumerate(out)],
            "unmatched": [i for i, w in enumerate(shown) if w and i not in inside],
            "flags": sorted(flags, key=lambda f: (f[1], f[0] != "token")),
        }

    def match(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, node_id, alias_id, score) of the best candidate of each span, by start."""
        return [(a, b, own[0][1].node_id, own[0][1].alias_id, own[0][0]) for _, _, _, a, b, _, _, _, own in self.read(text)["spans"]]

    def match_json(self, text: str) -> bytes:
        """All that was read, as canonical JSON: keys in order, weights and scores with four decimals."""
        r = self.read(text)
        s = lambda x: json.dumps(x, ensure_ascii=False)
        obj = lambda **kv: "{" + ",".join(f'"{k}":{v}' for k, v in kv.items()) + "}"
        many = lambda rows: "[" + ",".join(rows) + "]"
        tokens = many(obj(i=i, surface=s(t), norm=s(w), char_start=a, char_end=b, corrected_from=s(c), edit_distance=d) for i, t, w, a, b, c, d in r["tokens"])
        candidate = lambda score, a: obj(alias_id=a.alias_id, node_id=s(a.node_id), alias_type=s(a.alias_type), weight=f"{a.weight:.4f}", score=f"{score:.4f}")
        spans = many(obj(span_id=k, tok_start=a, tok_end=b, char_start=x, char_end=y, surface_original=s(o), matched_norm=s(w), fuzzy=s(f), candidates=many(candidate(*c) for c in own)) for k, a, b, x, y, o, w, f, own in r["spans"])
        flags = many(obj(type='"fuzzy_suppressed"', stage=s(stage), token_index=i, nearest=s(w), distance=d) for stage, i, w, d in r["flags"])
        whole = obj(matcher_version=s(MATCHER_VERSION), lexicon_version=s(self.lexicon.version), norm_version=s(NORM_VERSION), tok_version=s(TOK_VERSION), text=s(text), tokens=tokens, spans=spans, unmatched_token_indices=many(map(str, r["unmatched"])), flags=flags)
        return whole.encode()


def runs(text: str, words: int) -> list[str]:
    """All runs of so many words of a text, each once by its forms; a text of fewer words is one run."""
    own = [t for t, *_ in tokenize(text) if norm_token(t)]
    out: dict[tuple[str, ...], str] = {}
    for i in range(max(1, len(own) - words + 1) if own else 0):
        out.setdefault(tuple(map(norm_token, own[i : i + words])), " ".join(own[i : i + words]))
    return list(out.values())


@lru_cache(maxsize=1)
def _matcher(rows: tuple[tuple, ...]) -> Matcher:
    """The matcher of some aliases, which a process keeps from task to task with the words that it remembers."""
    return Matcher(compile_lexicon([Alias(*a) for a in rows])[1])


def match_texts(texts: DataFrame, aliases: list[Alias], key: str, text: str = "text") -> DataFrame:
    """(key, start, end, node_id, alias_id, score) of the aliases (a list whose size is the caller's bound).

    Texts longer than the matcher's input are read in pieces cut at white space; offsets are the
    text's own.  Raises ValueError for aliases that do not compile.
    """
    kind = texts.schema[key].dataType.simpleString()
    found, lexicon = compile_lexicon(aliases)
    if lexicon is None:
        raise ValueError(f"the aliases do not compile: {found}")
    shared = texts.sparkSession.sparkContext.broadcast(tuple(astuple(a) for a in lexicon.aliases))

    def run(batches):
        matcher = _matcher(shared.value)
        for rows in batches:
            out = [(k, at + a, at + b, *rest) for k, t in zip(rows[key], rows[text], strict=True) for at, piece in pieces(t or "") for a, b, *rest in matcher.match(piece)]
            yield pd.DataFrame(out, columns=[key, "start", "end", "node_id", "alias_id", "score"])

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, start int, end int, node_id string, alias_id long, score double")


def pieces(text: str, most: int = MAX_INPUT) -> list[tuple[int, str]]:
    """(start, piece) of a text, cut after white space where there is any; lone surrogates read as blanks."""
    text = "".join(" " if "\ud800" <= c <= "\udfff" else c for c in text)
    out, at = [], 0
    while at < len(text):
        end = at + most
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in " \n\t")
            end = cut + 1 if cut >= at else end
        out.append((at, text[at:end]))
        at = end
    return out


def match_tokens(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, pos, alias_id) of exact alias hits: windows of tokens (id, tokens array) joined with aliases (alias_id, seq array).

    Raises ValueError for aliases of more than MAX_TOKENS tokens, which the lexicon does not have.
    """
    sizes = [r[0] for r in aliases.select(F.size("seq").alias("n")).distinct().orderBy("n").limit(MAX_TOKENS + 2).collect()]
    if sizes and (sizes[-1] > MAX_TOKENS or sizes[0] < 1):
        raise ValueError(f"aliases have 1 to {MAX_TOKENS} tokens, not {sizes}")
    at = tokens.select("id", "tokens", F.posexplode_outer("tokens").alias("pos", "token"))
    gram = lambda n: F.when(F.col("pos") + n <= F.size("tokens"), F.concat_ws(US, *[F.get("tokens", F.col("pos") + k) for k in range(n)]))
    rows = at.select("id", "pos", F.explode_outer(F.array(*[gram(n) for n in sizes or [1]])).alias("g")).where("g is not null")
    return rows.join(aliases.select("alias_id", F.array_join("seq", US).alias("g")), "g").select("id", "pos", "alias_id")
