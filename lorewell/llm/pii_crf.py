"""A linear-chain conditional random field over word shapes, trained on a small labelled table.

A token's features are its shape, a word class and whether it touches the token before it, and
those of two tokens either side.  They are read from the bytes of many texts at once.  The model
is fitted by gradient ascent on the exact likelihood (forward-backward) and decoded by Viterbi,
both over batches of sequences in numpy.  A sequence is a line.  Where an upper bound on what
other labels could gain shows that a token is outside in the best path, the line is cut, so
that Viterbi runs on the stretches between: the result is that of the whole line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from lorewell.llm import pii_table, spans

#: Labels: outside, then beginning and inside of each kind the field finds.
KINDS = ("email", "phone", "person", "id", "secret")
LABELS = ("O", *[f"{x}-{k}" for k in KINDS for x in "BI"])
AROUND = 2
STEPS, RATE, PENALTY = 150, 0.15, 0.02

#: Words that tell a kind, by class.
CUES = {
    "at": ("at", "arroba"),
    "dot": ("dot", "punkt", "punto", "point"),
    "tld": ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "info"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "handy", "appelez", "ring"),
    "title": ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "sr", "sra"),
    "name": ("name", "named", "signed", "contact", "regards"),
    "id": ("ssn", "social", "security", "passport", "insurance", "licence", "iban"),
    "mail": ("email", "mail", "e", "write", "reach", "correo"),
    "secret": ("token", "password", "passwd", "secret", "key", "bearer"),
    "given": ("alice", "anna", "carlos", "carmen", "claire", "david", "elena", "emma", "frank", "hans", "isabel", "james", "john", "josé", "juan", "julia", "karl", "klaus", "laura", "luis", "marie", "maria", "michael", "olga", "pablo", "paul", "peter", "pierre", "sophie", "thomas", "victor"),
}
N_CLASS = len(CUES) + 1

#: Shapes, in order; other tokens are the last.
SHAPES = ("edge", "a", "Aa", "A", "d1", "d2", "d3", "d4", "d5-8", "d9+", "@", ".", ",", "-", "(", ")", "+", "/", ":", "_", "[", "]", "=", '"', "mixed", "other")
_SHAPE = {s: i for i, s in enumerate(SHAPES)}
#: Feature sizes: shape, word class, touching.
SIZES = (len(SHAPES), N_CLASS, 2)

_L, _D, _S, _O = 0, 1, 2, 3
_POINTS = [chr(i) for i in range(0x10000)]
_KIND = np.array([_L if c.isalpha() else _D if c.isdecimal() else _S if c.isspace() else _L if c.isalnum() else _O for c in _POINTS], np.uint8)
_UPPER = np.array([c.isupper() for c in _POINTS])
_SINGLE = np.array([_SHAPE.get(c, _SHAPE["other"]) for c in _POINTS[:128]], np.int64)
_DIGITS = np.array([_SHAPE[x] for x in ("other", "d1", "d2", "d3", "d4", *["d5-8"] * 4, "d9+")])


def _cue_table() -> tuple[np.ndarray, np.ndarray, int]:
    words = [(w.encode(), i + 1) for i, ws in enumerate(CUES.values()) for w in ws]
    ends = np.cumsum([len(w) for w, _ in words])
    h = spans.hash_spans(np.frombuffer(b"".join(w for w, _ in words), np.uint8), np.r_[0, ends[:-1]], ends)
    order = np.argsort(h)
    return h[order], np.array([c for _, c in words])[order], max(len(w) for w, _ in words)


_CUE_HASH, _CUE_CLASS, _CUE_LONGEST = _cue_table()


@dataclass
class Tokens:
    """Byte places, line numbers and features (a row of shapes, of classes, of touching) of the tokens of some texts."""

    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    x: np.ndarray


def read(raw: np.ndarray, at: np.ndarray) -> Tokens:
    """The tokens of texts: runs of letters, runs of digits, and all other characters but white space, each alone.

    Characters beyond the first plane count as others.
    """
    none = np.zeros(0, np.int64)
    if not len(raw):
        return Tokens(none, none, none, np.zeros((3, 0), np.int64))
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    b = raw[lead]
    point = b.astype(np.int64)
    for low, high, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3)):
        i = np.flatnonzero((b >= low) & (b < high))
        value = b[i].astype(np.int64) & (0x1F if size == 2 else 0x0F)
        for k in range(1, size):
            value = value << 6 | raw[lead[i] + k] & 0x3F
        point[i] = value
    point[b >= 0xF0] = 0xFFFF  # no character: an other
    kind, n = _KIND[point], len(lead)
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(lead, at[:-1])] = True
    head = head[:n]
    begins = head | (kind == _O) | (kind != np.r_[_S, kind[:-1]])
    bounds = np.r_[np.flatnonzero(begins), n]
    own = np.flatnonzero(kind[bounds[:-1]] != _S)
    s, e = bounds[own], bounds[own + 1]
    first = head.copy()
    first[1:] |= b[:-1] == 10
    line = np.cumsum(first)[s]
    touching = np.zeros(len(s), np.int64)
    touching[s > 0] = (kind[s[s > 0] - 1] != _S) & ~head[s[s > 0]]
    size, k = e - s, kind[s]
    upper = np.r_[0, np.cumsum(_UPPER[point])]
    ups = upper[e] - upper[s]
    word = np.where(ups == 0, _SHAPE["a"], np.where(ups == size, _SHAPE["A"], np.where((ups == 1) & _UPPER[point[s]], _SHAPE["Aa"], _SHAPE["mixed"])))
    single = np.where(point[s] < 128, _SINGLE[np.minimum(point[s], 127)], _SHAPE["other"])
    shape = np.where(k == _L, word, np.where(k == _D, _DIGITS[np.minimum(size, 9)], single))
    start, end = lead[s], np.r_[lead, len(raw)][e]
    cls = np.zeros(len(s), np.int64)
    may = np.flatnonzero((k == _L) & (end - start <= _CUE_LONGEST))
    h = spans.hash_spans(spans.LOWER[raw], start[may], end[may])
    place = np.minimum(np.searchsorted(_CUE_HASH, h), len(_CUE_HASH) - 1)
    cls[may] = np.where(_CUE_HASH[place] == h, _CUE_CLASS[place], 0)
    return Tokens(start, end, line, np.stack([shape, cls, touching]))


_MARK = re.compile(r"\[(%s) " % "|".join(KINDS))


def training_table() -> list[tuple[np.ndarray, list[str]]]:
    """Features and labels of the lines of the labelled table."""
    out = []
    for line in pii_table.LINES:
        text, marked = "", []
        rest = line
        while m := _MARK.search(rest):
            text += rest[: m.start()]
            depth, i = 1, m.end()
            while depth:
                depth += {"[": 1, "]": -1}.get(rest[i], 0)
                i += 1
            value = rest[m.end() : i - 1]
            marked.append((m[1], len(text.encode()), len((text + value).encode())))
            text, rest = text + value, rest[i:]
        data = np.frombuffer((text + rest).encode(), np.uint8)
        t = read(data, np.array([0, len(data)]))
        labels = ["O"] * len(t.start)
        for kind, a, z in marked:
            inside = np.flatnonzero((t.start >= a) & (t.end <= z))
            for j, i in enumerate(inside):
                labels[i] = f"{'I' if j else 'B'}-{kind}"
        out.append((t.x, labels))
    return out


def _padded(rows: list[np.ndarray], fill: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([r.shape[-1] for r in rows])
    out = np.full((len(rows), *rows[0].shape[:-1], max(1, int(size.max()))), fill, np.int64)
    for i, r in enumerate(rows):
        out[i, ..., : r.shape[-1]] = r
    return out, size


#: What float32 sums may be off by, with a margin.
_SLACK = 1e-2


@dataclass
class Field:
    weights: list[np.ndarray]  # of each feature: (offset, value, label)
    moves: np.ndarray  # (label, label), with a row of starts at the end

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(sequence, feature, token) to (sequence, token, label)."""
        wide = np.pad(x, ((0, 0), (0, 0), (AROUND, AROUND)))
        n = x.shape[2]
        return sum(w[o][wide[:, f, o : o + n]] for f, w in enumerate(self.weights) for o in range(2 * AROUND + 1))

    def _scores(self, t: Tokens) -> np.ndarray:
        """(token, label): the emissions of the tokens of many lines."""
        code = (t.x[0] * SIZES[1] + t.x[1]) * SIZES[2] + t.x[2]
        shape, cls, touching = np.unravel_index(np.arange(np.prod(SIZES)), SIZES)
        out, n = np.zeros((len(code), len(LABELS)), np.float32), len(code)
        for o in range(2 * AROUND + 1):
            w = [w[o] for w in self.weights]
            table = (w[0][shape] + w[1][cls] + w[2][touching]).astype(np.float32)
            near = np.zeros(n, np.int64)
            a, b = max(0, AROUND - o), n - max(0, o - AROUND)
            if a < b:
                inside = t.line[a:b] == t.line[a + o - AROUND : b + o - AROUND]
                near[a:b] = np.where(inside, code[a + o - AROUND : b + o - AROUND], 0)
            out += table[near]
        return out

    def find(self, t: Tokens) -> list[tuple[int, int, str]]:
        """(first token, token after the last, kind) of what the field finds in all lines."""
        if not len(t.start):
            return []
        e = self._scores(t)
        last = np.r_[t.line[1:] != t.line[:-1], True]
        first = np.r_[True, last[:-1]]
        live = np.flatnonzero(self._live(e, t.line, first, last))
        if not len(live):
            return []
        cuts = np.flatnonzero((np.diff(live) > 1) | (np.diff(t.line[live]) != 0)) + 1
        parts = [(p[0], p[-1] + 1) for p in np.split(live, cuts)]
        out = []
        for (a, _), labels in zip(parts, self.decode([e[a:b].astype(np.float64) for a, b in parts], [bool(first[a]) for a, _ in parts], [bool(last[b - 1]) for _, b in parts]), strict=True):
            out += [(int(a + x), int(a + y), kind) for kind, x, y in spans_of(labels)]
        return out

    def _live(self, e: np.ndarray, line: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The tokens that a stretch of one kind may cover; all others are outside in the best path.

        Putting a stretch outside changes a path's score by the stretch's gain: of entering it
        instead of staying outside, of its labels, and of leaving it.  A stretch whose gain is
        at most 0, whatever stands around it, is in no best path.
        """
        k, moves = len(LABELS), self.moves
        outside, stay = e[:, 0].astype(np.float64), moves[0, 0]
        shift, out = (line - line[0]).astype(np.float64), np.zeros(len(line), bool)
        others = [0, *range(1, k, 2)]
        for b in range(1, k, 2):
            enter = np.where(first, moves[k, b] - moves[k, 0], (moves[:k, b] - moves[:k, 0]).max())
            leave = np.where(last, 0.0, max((moves[j, others] - moves[0, others]).max() for j in (b, b + 1)))
            begin = e[:, b] - outside + enter
            more = np.cumsum(e[:, b + 1] - outside + (max(moves[b, b + 1], moves[b + 1, b + 1]) - stay))
            step = 4 * (np.abs(more).max() + np.abs(begin).max() + np.abs(leave).max()) + 1
            # The best beginning up to each token, and the best end from it, in its line.
            start = np.maximum.accumulate(begin - more + shift * step) - shift * step
            end = np.maximum.accumulate((more + leave - shift * step)[::-1])[::-1] + shift * step
            out |= start + end > -_SLACK
        return out

    def decode(self, rows: list[np.ndarray], first: list[bool] | None = None, last: list[bool] | None = None) -> list[np.ndarray]:
        """The best labels of each stretch of scores (token, label), by Viterbi; stretches of like length together.

        ``first`` and ``last`` tell whether a stretch begins and ends its line (else the tokens beside it are outside).
        """
        first, last = first or [True] * len(rows), last or [True] * len(rows)
        out: list = [np.zeros(0, np.int64)] * len(rows)
        order = sorted((i for i, r in enumerate(rows) if len(r)), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            stop = at
            while stop < len(order) and (stop - at + 1) * len(rows[order[stop]]) <= max(1 << 16, len(rows[order[at]])):
                stop += 1
            part = order[at : max(stop, at + 1)]
            for i, labels in zip(part, self._viterbi([rows[i] for i in part], np.array([first[i] for i in part]), np.array([last[i] for i in part])), strict=True):
                out[i] = labels
            at += len(part)
        return out

    def _viterbi(self, rows: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        size = np.array([len(r) for r in rows])
        n, length, k = len(rows), int(size.max()), len(LABELS)
        e = np.zeros((n, length, k))
        for i, r in enumerate(rows):
            e[i, : len(r)] = r
        best, back = np.where(first[:, None], self.moves[k], self.moves[0]) + e[:, 0], np.zeros((n, length, k), np.int8)
        final = best.copy()
        for t in range(1, length):
            step = best[:, :, None] + self.moves[None, :k]
            back[:, t] = step.argmax(axis=1)
            best = step.max(axis=1) + e[:, t]
            final[size > t] = best[size > t]
        final = final + np.where(last[:, None], 0, self.moves[:k, 0])
        labels = np.zeros((n, length), np.int64)
        end = final.argmax(axis=1)
        for t in range(length - 1, -1, -1):
            ends = size - 1 == t
            if t < length - 1:
                carried = back[np.arange(n), t + 1, labels[:, t + 1]]
                labels[:, t] = np.where(size - 1 > t, carried, 0)
            labels[ends, t] = end[ends]
        return [labels[i, : size[i]] for i in range(n)]


def _gradient(field: Field, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> Field:
    """Of the log likelihood, per sequence, by forward and backward sums."""
    e = field.emissions(x)
    n, length, k = e.shape
    live = np.arange(length)[None] < size[:, None]
    add = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    forward, backward = np.zeros((n, length, k)), np.zeros((n, length, k))
    forward[:, 0] = field.moves[k] + e[:, 0]
    for t in range(1, length):
        forward[:, t] = np.where(live[:, t, None], add(forward[:, t - 1, :, None] + field.moves[None, :k], 1) + e[:, t], forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        backward[:, t] = np.where(live[:, t + 1, None], add(field.moves[None, :k] + (e[:, t + 1] + backward[:, t + 1])[:, None], 2), 0)
    total = add(forward[:, -1], 1)
    own = np.exp(forward + backward - total[:, None, None]) * live[:, :, None]
    wrong = np.eye(k)[y] * live[:, :, None] - own
    moves = np.zeros_like(field.moves)
    moves[k] = wrong[:, 0].sum(axis=0)
    for t in range(1, length):
        pair = np.exp(forward[:, t - 1, :, None] + field.moves[None, :k] + (e[:, t] + backward[:, t])[:, None] - total[:, None, None]) * live[:, t, None, None]
        moves[:k] -= pair.sum(axis=0)
        np.add.at(moves, (y[:, t - 1][live[:, t]], y[:, t][live[:, t]]), 1)
    out = Field([np.zeros_like(w) for w in field.weights], moves / n)
    wide = np.pad(x, ((0, 0), (0, 0), (AROUND, AROUND)))
    for o in range(2 * AROUND + 1):
        for f, w in enumerate(out.weights):
            np.add.at(w[o], wide[:, f, o : o + length].ravel(), wrong.reshape(-1, k) / n)
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field, fitted on the labelled table (the same on every machine)."""
    table = training_table()
    x, length = _padded([x for x, _ in table], 0)
    y, _ = _padded([np.array([LABELS.index(v) for v in labels]) for _, labels in table], 0)
    k = len(LABELS)
    p = [*[np.zeros((2 * AROUND + 1, size, k)) for size in SIZES], np.zeros((k + 1, k))]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, STEPS + 1):
        g = _gradient(Field(p[:-1], p[-1]), x, y, length)
        for i, d in enumerate((*g.weights, g.moves)):
            d = d - PENALTY / len(table) * p[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.99 * v[i] + 0.01 * d * d
            p[i] = p[i] + RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    inside = [i for i, name in enumerate(LABELS) if name[0] == "I"]
    for i in inside:  # a kind goes on only from itself
        allowed = {i, i - 1}
        p[-1][[j for j in range(k + 1) if j not in allowed], i] = -1e6
    return Field(p[:-1], p[-1])


def spans_of(labels: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, first token, token after the last) of a sequence's labels."""
    out = []
    for i, v in enumerate(labels):
        name = LABELS[v]
        if name[0] == "B":
            out.append([name[2:], i, i + 1])
        elif name[0] == "I" and out and out[-1][2] == i and out[-1][0] == name[2:]:
            out[-1][2] = i + 1
    return [tuple(s) for s in out]
