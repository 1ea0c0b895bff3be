"""Byte-level text kernels: words, hashes and shingles of whole Arrow columns.

The functions work on the UTF-8 bytes of many documents at once, so that no
Python object is made per word.  All of them are pure functions of the bytes:
a retried task gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass of the kernels looks at (one longer document is a pass of its own).
SLICE_BYTES = 1 << 20

_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (one more than rows); null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def passes(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    raw, at = column_bytes(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, stop, raw[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _C2
    x ^= x >> _U(27)
    x *= _C3
    x ^= x >> _U(31)
    return x


def split_spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of bytes marked in ``inside`` (a table of 256)."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    m = inside[raw]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] |= m[edge]
    last[edge - 1] |= m[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, "right") - 1


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the words ``[^\\x20\\x09-\\x0D]+``."""
    return split_spans(raw, at, ~SPACE)


def lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the \\n-split lines; each document has one at least."""
    cut = np.flatnonzero(raw == 10)
    starts = np.concatenate([at[:-1], cut + 1])
    ends = np.concatenate([cut, at[1:]])
    doc = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, cut, "right") - 1])
    order = np.lexsort((starts, doc))
    closing = np.concatenate([np.searchsorted(at, cut, "right") - 1, np.arange(len(at) - 1)])
    return starts[order], ends[np.lexsort((ends, closing))], doc[order]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: eight bytes at a time, all spans at once."""
    length = (ends - starts).astype(np.int64)
    h = mix(length.astype(_U) + _C1)
    if not len(starts) or not len(raw):
        return h
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    todo, offset = np.arange(len(starts)), 0
    while len(todo):
        left = length[todo] - offset
        todo, left = todo[left > 0], left[left > 0]
        if not len(todo):
            break
        lane = lanes[starts[todo] + offset]
        part = left < 8
        lane[part] &= (_U(1) << (left[part].astype(_U) * _U(8))) - _U(1)
        h[todo] = mix((h[todo] ^ lane) * _C1 + _U(offset + 1))
        offset += 8
    return h


def equal_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Has each span the bytes of the span of index ``other``?"""
    size = ends - starts
    same = size == size[other]
    if not len(starts) or not len(raw):
        return same
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    todo, offset = np.flatnonzero(same & (other != np.arange(len(starts)))), 0
    while len(todo):
        left = size[todo] - offset
        todo, left = todo[left > 0], left[left > 0]
        differ = lanes[starts[todo] + offset] ^ lanes[starts[other[todo]] + offset]
        part = left < 8
        differ[part] &= (_U(1) << (left[part].astype(_U) * _U(8))) - _U(1)
        same[todo[differ != 0]] = False
        todo, offset = todo[differ == 0], offset + 8
    return same


def ngrams(h: np.ndarray, doc: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each document, and their documents.

    With ``short``, a document of fewer words has its whole sequence as its one window.
    """
    if not len(h):
        return h, doc
    size = len(h) - n + 1
    whole, where = np.zeros(0, _U), np.zeros(0, np.int64)
    if size > 0:
        keep = doc[:size] == doc[n - 1 :]
        g = h[:size].copy()
        for j in range(1, n):
            g = mix(g * _C1 + h[j : size + j])
        whole, where = g[keep], doc[:size][keep]
    if short and n > 1:
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[first, len(doc)])
        few = count < n
        if few.any():
            at, left = first[few], count[few]
            g = h[at].copy()
            for j in range(1, n - 1):
                on = left > j
                g[on] = mix(g[on] * _C1 + h[at[on] + j])
            whole, where = np.r_[whole, g], np.r_[where, doc[at]]
            order = np.argsort(where, kind="stable")
            whole, where = whole[order], where[order]
    return whole, where


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each document, and their documents."""
    if lower:
        raw = LOWER[raw]
    starts, ends, doc = words(raw, at)
    return hash_spans(raw, starts, ends), doc


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each row of a column (A-Z lower-cased)."""
    for first, stop, raw, at in passes(column):
        h, doc = word_hashes(raw, at)
        g, where = ngrams(h, doc, n)
        cuts = np.searchsorted(where, np.arange(stop - first + 1))
        for i in range(stop - first):
            yield np.unique(g[cuts[i] : cuts[i + 1]])
