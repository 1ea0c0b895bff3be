"""Positions of a text that depend on what stands around them alone, so that equal passages have equal ones.

Of each window of bytes the k-byte string of the smallest hash is an anchor: two texts that share a
window share its anchor, at the same place of it.
"""

from __future__ import annotations

import numpy as np

from lorewell.llm.spans import mix

#: Bytes of an anchor's string (a multiple of eight), and bytes that one pass looks at.
ANCHOR, STEP = 24, 1 << 18
_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))


def _hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on."""
    words, n = lanes(raw), len(raw) - ANCHOR + 1
    h = words[:n] * _C1
    for at, c in zip(range(8, ANCHOR, 8), (_C2, _C3, _C2, _C3), strict=False):
        h ^= h >> _U(32)
        h += words[at : at + n]
        h *= c
    h ^= h >> _U(29)
    return h


def _slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` over each run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        x = take(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return take(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the anchors of all windows of ``length`` bytes within one document, and their hashes."""
    width, found, keys = length - ANCHOR + 1, [], []
    for low in range(0, max(0, len(raw) - length + 1), STEP):
        part = raw[low : low + STEP + length - 1]
        h = _hashes(part)
        small = (h >> _U(32)).astype(np.uint32) | np.uint32(1)
        least = _slide(small, width, np.minimum)
        edges = at[np.searchsorted(at, low, "right") : np.searchsorted(at, low + len(part), "left")] - low
        for e in edges:  # windows that would reach into the next document
            least[max(0, e - length + 1) : max(0, e)] = 0
        most = _slide(np.pad(least, width - 1), width, np.maximum)
        on = np.flatnonzero(small == most)
        found.append(on + low)
        keys.append(h[on])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    places, first = np.unique(np.concatenate(found), return_index=True)
    return places, mix(np.concatenate(keys)[first])
