"""Token ids of whole columns under a byte-level BPE vocabulary.

The vocabulary's pre-tokenizer cuts a text into pieces that are encoded each on its
own, so that a piece met before need not be encoded again.  Pieces are cut and hashed on
bytes, many texts at a time; texts with other characters than Latin ones, and those that
hold a special token's string, go through the tokenizer itself.
"""

from __future__ import annotations

import itertools
import os
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from lorewell.llm import spans

#: Pieces that a worker remembers, and bytes of a longer piece that it does not remember.
REMEMBERED, LONGEST = 250_000, 256
_U = np.uint64

# Classes of characters: letter, digit, white space, other; the apostrophe is told apart.
_L, _N, _S, _O = 0, 1, 2, 3


def _classes() -> np.ndarray:
    out = np.full(0x250, _O, np.uint8)
    for i in range(0x250):
        c = chr(i)
        if c.isalpha():
            out[i] = _L
        elif c.isnumeric():
            out[i] = _N
        elif c.isspace() and i not in (0x1C, 0x1D, 0x1E, 0x1F):
            out[i] = _S
    return out


_CLASS = _classes()
_CONTRACTIONS = (b"'re", b"'ve", b"'ll", b"'s", b"'t", b"'m", b"'d")


def cut_pieces(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the pieces of Latin texts (characters below U+0250).

    The rule is the public one of byte-level BPE: contractions, an optional space with a run of
    letters, of digits or of others, and white space whose last character stays with what follows.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    code = raw[lead].astype(np.int64)
    two = code >= 0xC0
    code[two] = ((code[two] & 0x1F) << 6) | (raw[lead[two] + 1] & 0x3F)
    kind = _CLASS[code]
    m = len(lead)
    head = np.zeros(m + 1, bool)
    doc_at = np.searchsorted(lead, at)
    head[doc_at] = True
    head = head[:m]
    space = code == 32
    new = head.copy()
    new[1:] |= kind[1:] != kind[:-1]
    # The last of a run of white space goes with what follows if it is a blank, and else stands alone.
    white = kind == _S
    last = white.copy()
    last[:-1] &= ~white[1:] & ~head[1:]
    last[-1] = False  # it ends the text, and so do those before a head
    last &= np.r_[~head[1:], False]
    new |= last
    after = np.r_[False, (last & space)[:-1]]
    new &= ~after | head
    # Contractions end where they end, whatever follows.
    quote = np.flatnonzero((code == 39) & new)
    if len(quote):
        data = raw.tobytes()
        ends_of_docs = at[1:]
        for i in quote:
            p = int(lead[i])
            for c in _CONTRACTIONS:
                if data.startswith(c, p) and p + len(c) <= ends_of_docs[np.searchsorted(at, p, "right") - 1]:
                    new[i + 1 : i + len(c)] = False
                    if i + len(c) < m:
                        new[i + len(c)] = True
                    break
    starts = lead[new]
    return starts, np.r_[starts[1:], n], np.searchsorted(at, starts, "right") - 1


class Encoder:
    """Ids of texts, with a memory of pieces."""

    def __init__(self, path: str) -> None:
        import json

        self.path = path
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        self.special = [t["content"].encode() for t in whole.get("added_tokens", [])]
        self.piece = self._pieces(path, whole["model"])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, which few texts need."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _pieces(self, path: str, model: dict):
        """Ids of one piece (bytes): by its ranks, for a vocabulary whose merges are in order of id."""
        import tiktoken

        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in itertools.pairwise(merged)):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(letters))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        ranks = {k: v for k, v in ranks.items() if k not in self.special}
        core = tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return core.encode_single_piece

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of some distinct pieces, as little-endian 32-bit words.

        What has been met since the last change of generations is kept for another one, so that
        common pieces stay while rare ones go.
        """
        if len(self.young) > REMEMBERED // 2:
            self.young, self.old = {}, self.young
        out = list(map(self.young.get, pieces))
        for i, known in enumerate(out):
            if known is None:
                piece = pieces[i]
                known = self.old.get(piece)
                if known is None:
                    ids = self.piece(piece)
                    known = struct.pack(f"<{len(ids)}I", *ids)
                out[i] = known
                if len(piece) <= LONGEST:
                    self.young[piece] = known
        return out

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) of runs of rows."""
        for first, stop, raw, at in spans.passes(column):
            whole = raw.tobytes()
            odd = np.flatnonzero(np.add.reduceat(np.r_[raw >= 0xC9, False].astype(np.int64), at[:-1]) * (at[1:] > at[:-1])) if len(raw) else np.zeros(0, np.int64)
            odd = set(odd.tolist())
            for token in self.special:
                i = whole.find(token)
                while i >= 0:
                    odd.add(int(np.searchsorted(at, i, "right")) - 1)
                    i = whole.find(token, i + 1)
            if odd:
                yield from self._mixed(first, whole, at, odd)
            else:
                yield first, *self._latin(raw, whole, at)

    def _mixed(self, first: int, whole: bytes, at: np.ndarray, odd: set[int]):
        for i in range(len(at) - 1):
            part = whole[at[i] : at[i + 1]]
            if i in odd:
                ids = np.array(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids, np.uint32)
                yield first + i, ids, np.array([0, len(ids)])
            else:
                yield first + i, *self._latin(np.frombuffer(part, np.uint8), part, np.array([0, len(part)]))

    def _latin(self, raw: np.ndarray, whole: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, doc = cut_pieces(raw, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        _, where, back = np.unique(spans.hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        if not spans.equal_spans(raw, starts, ends, where[back]).all():  # two pieces of one hash
            first: dict[bytes, int] = {}
            back = np.array([first.setdefault(whole[a:b], len(first)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            where = np.unique(back, return_index=True)[1]
        found = self._ids_of([whole[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = (np.cumsum(size) - size)[back]
        n = size[back]
        ends_at = np.cumsum(n)
        index = np.repeat(begin - (ends_at - n), n) + np.arange(ends_at[-1])
        return ids[index], np.r_[0, ends_at][np.searchsorted(doc, np.arange(len(at)))]
