"""URL filters: all glob rules at once over each canonical URL, by a bit-parallel automaton.

A rule's literal characters take one bit each in a row of 64-bit words; reading a byte
shifts the bits of all rules at once (Shift-And), and a bit before a ``*`` also holds its
place.  numpy does this for many URLs at a time.  The automaton reads ``.host`` + 0xFF +
``path``: 0xFF is in no UTF-8 text, so that a rule's host and path cannot run into each
other.  Host rules read the URL's own host and path; block globs read the canonical ones,
without user, port, closing dots, repeated slashes, needless escapes or capitals.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
MARK = b"\xff"

#: (verdict, host, path): the contract's rules.
HOST_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Globs over the canonical URL that block what no host rule decides: spam, gambling, adult and advertising hosts, pages of logins and shops, files that are no text.
BLOCK_GLOBS = (
    "*.spam*|*", "*-spam*|*", "*-pills.*|*", "*viagra*|*", "*casino*|*", "*-poker*|*", "*.poker*|*", "*-betting.*|*", "*porn*|*", "*.xxx|*", "*.adult|*", "*-escort*|*",
    "*.doubleclick.*|*", "*.adserver.*|*", "*.ads.*|*", "*.adservice.*|*", "*.tracker.*|*", "*.tracking.*|*", "*.banner??.*|*", "*.click-*|*", "*.warez.*|*", "*-torrents.*|*",
    "*|*/wp-login*", "*|*/wp-admin/*", "*|*/cgi-bin/*", "*|*/login", "*|*/login/*", "*|*/signin*", "*|*/register.*", "*|*/cart", "*|*/cart/*", "*|*/checkout*", "*|*/unsubscribe*", "*|*/xmlrpc.php",
    "*|*.exe", "*|*.zip", "*|*.gz", "*|*.apk", "*|*.dmg", "*|*.iso", "*|*.jpg", "*|*.jpeg", "*|*.png", "*|*.gif", "*|*.css", "*|*.js", "*|*.mp3", "*|*.mp4",
)
#: The characters that a URL need not escape, lower-cased.
UNRESERVED = "abcdefghijklmnopqrstuvwxyz0123456789-._~"
#: Bytes of URLs in one matrix.
MATRIX_BYTES = 1 << 22


class Automaton:
    """Shift-And over glob rules given as bytes (``*``: any run, ``?``: any byte)."""

    def __init__(self, globs: Iterable[bytes]) -> None:
        bits, first, always, loop, accept, empty = [], [], [], [], [], []
        for glob in globs:
            head, at = len(bits), []
            lead = pending = False
            for c in glob:
                if c == 42:
                    if at:
                        loop.append(len(bits) - 1)
                    else:
                        lead = True
                    pending = True
                else:
                    at.append(len(bits))
                    bits.append(None if c == 63 else c)
                    pending = False
            empty.append(not at and pending)
            if at:
                first.append(head)
                if lead:
                    always.append(head)
            accept.append(len(bits) - 1 if at else -1)
        self.width = max(1, -(-len(bits) // 64))
        self.accept, self.empty = np.array(accept), np.array(empty)
        self.table = np.zeros((256, self.width), _U)
        for i, c in enumerate(bits):
            rows = slice(None) if c is None else c
            self.table[rows, i // 64] |= _U(1 << (i % 64))
        self.first, self.always, self.loop = map(self._mask, (first, always, loop))

    def _mask(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.width, _U)
        for i in places:
            out[i // 64] |= _U(1 << (i % 64))
        return out

    def match(self, texts: list[bytes]) -> np.ndarray:
        """A row of booleans (one for each rule) for each text: does the rule fit the whole text?"""
        out = np.zeros((len(texts), len(self.accept)), bool)
        size = np.array([len(x) for x in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        at = 0
        while at < len(texts):
            longest = max(1, int(size[order[at]]))
            part = order[at : at + max(1, MATRIX_BYTES // longest)]
            out[part] = self._run([texts[i] for i in part], size[part])
            at += len(part)
        return out

    def _run(self, texts: list[bytes], size: np.ndarray) -> np.ndarray:
        state = np.zeros((len(texts), self.width), _U)
        raw = np.frombuffer(b"".join(x.ljust(int(size[0]), b"\0") for x in texts), np.uint8).reshape(len(texts), -1)
        live = len(texts)
        for i in range(int(size[0])):
            while live and size[live - 1] <= i:
                live -= 1
            d = state[:live]
            moved = d << _U(1)
            moved[:, 1:] |= d[:, :-1] >> _U(63)
            moved &= ~self.first
            moved |= self.first if i == 0 else self.always
            state[:live] = (moved & self.table[raw[:live, i]]) | (d & self.loop)
        place = np.maximum(self.accept, 0)
        hit = (state[:, place // 64] >> (place % 64).astype(_U)) & _U(1)
        return np.where(self.accept >= 0, hit.astype(bool), self.empty)


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of an URL; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    host = rest[:end]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host) if any("A" <= c <= "Z" for c in host) else host, tail[:stop]


_LOWER = {i: i + 32 for i in range(65, 91)}


def canonical(host: str, path: str) -> tuple[str, str]:
    """A host and path without what tells no page apart: A-Z become lower-cased, unreserved characters unescaped once."""
    host = re.sub(r":[0-9]*$", "", host.rpartition("@")[2]).rstrip(".")
    first, *rest = path.translate(_LOWER).split("%")
    plain = lambda x: chr(int(x[:2], 16)).translate(_LOWER) if re.match("[0-9a-f]{2}", x) else ""
    path = first + "".join(c + x[2:] if (c := plain(x)) and c in UNRESERVED else "%" + x for x in rest)
    return host.translate(_LOWER), re.sub("/+", "/", path)


def _literal(text: str) -> bytes:
    if "*" in text or "?" in text:
        raise ValueError(f"a host rule has no wildcards: {text}")
    return text.encode()


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, block_globs=BLOCK_GLOBS, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Per row of ``pages``: (``id_col``, host, path, rule, verdict).

    A host rule fits its host and all subdomains if the path starts with the rule's; the
    longest wins (the first of equal ones).  Where none fits, a glob that fits the canonical
    ``.host|path`` blocks, and all else is allowed.  Cases: a null URL or one without ``://``
    has an empty host and path, and is allowed unless a glob fits; a very long URL is read by
    itself, byte by byte; repeated rows are judged alike; a null id passes through; an empty
    table gives no row; further columns are ignored, whatever their names.
    """
    host_rules = sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
    ruler = Automaton([b"*." + _literal(h) + MARK + _literal(p) + b"*" for _, h, p in host_rules])
    blocker = Automaton([g.encode().replace(b"|", MARK) for g in block_globs])
    names = np.array([h + p for _, h, p in host_rules], object)
    says = np.array([v for v, _, _ in host_rules], object)

    def read(automaton: Automaton, found: list[tuple[str, str]]) -> np.ndarray:
        return automaton.match([b"." + h.encode() + MARK + p.encode() for h, p in found])

    def run(batches):
        for batch in batches:
            found = [parts(x) for x in batch.column(1).to_pylist()]
            fits, blocked = read(ruler, found), read(blocker, [canonical(h, p) for h, p in found]).any(axis=1)
            ruled, best = fits.any(axis=1), fits.argmax(axis=1) if len(names) else np.zeros(len(found), int)
            rule = np.where(ruled, names[best], None) if len(names) else np.full(len(found), None)
            verdict = np.where(blocked, "block", "allow")
            verdict = np.where(ruled, says[best], verdict) if len(names) else verdict
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string()), pa.array(rule.tolist(), pa.string()), pa.array(verdict.tolist(), pa.string())], names=["id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
