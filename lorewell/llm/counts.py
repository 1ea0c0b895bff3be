"""Corpus-wide counts of hashed keys, shuffled once and packed.

Documents are dealt into batches.  Each batch sends the sorted distinct keys
of its documents with their counts, cut into key ranges; a range adds up the
counts of all batches and answers each batch with one bit per key (does it
occur outside the batch, or more than once) and the totals of those keys.  A
key of a third of all documents costs one entry a batch, so that no range can
grow hot, and the batch finds its answers by position, so that no key travels
back.

Keys are cut to ``KEY_BITS + range_bits`` bits (64 at most).  Two keys that agree there are
counted together; with RANGE_KEYS keys a range, that befalls one key in four million,
whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a batch and keys in a range, which bound what one task holds.
BATCH_BYTES, RANGE_KEYS = 4 << 20, 1 << 20
#: Bits of a key within its range.
KEY_BITS = 42
COUNTS = "b long, r int, seen binary, n binary"
_U = np.uint64


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan(spark, n_bytes: int, n_keys: int) -> tuple[int, int]:
    """(batches, range bits) for so much text and so many keys; neither depends on any one key."""
    batches = max(partitions(spark), -(-n_bytes // BATCH_BYTES), 1)
    return int(batches), max(4, int(np.ceil(np.log2(max(1, n_keys / RANGE_KEYS)))))


def batch_of(column, batches: int):
    return F.pmod(F.xxhash64(column), F.lit(batches))


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, byte by byte: sorted or small numbers then compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def squeeze(x: np.ndarray, width: int) -> bytes:
    """Whole numbers below 256^width, small ones in few bytes: their count, then compressed planes."""
    return len(x).to_bytes(4, "little") + pa.compress(planes(x, width), codec="zstd", asbytes=True)


def unsqueeze(raw: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    return unplanes(pa.decompress(raw[4:], decompressed_size=n * width, codec="zstd", asbytes=True), width)


def gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys of one range as steps from one to the next (the running sum gives them back)."""
    keys = keys & _U((1 << KEY_BITS) - 1)
    return np.diff(keys, prepend=_U(0))


def cut(keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct cut keys, their counts, and the place of each given key among them."""
    keys, where = np.unique(keys >> _U(max(0, 64 - KEY_BITS - bits)), return_inverse=True)
    return keys, np.bincount(where, weights=counts, minlength=len(keys)).astype(np.int64), where


def _edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each range begins among sorted cut keys, and their end."""
    return np.r_[np.searchsorted(keys, np.arange(1 << bits, dtype=_U) << _U(min(KEY_BITS, 64 - bits))), len(keys)]


def _send(b: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.Table:
    edges = _edges(keys, bits)
    rows = [(i, b, squeeze(gaps(keys[x:y]), 6), squeeze(counts[x:y], 4)) for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
    r, bs, k, n = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"r": pa.array(r, pa.int32()), "b": pa.array(bs, pa.int64()), "k": pa.array(k, pa.binary()), "n": pa.array(n, pa.binary())})


def _add(table: pa.Table) -> pa.Table:
    r, batch = table["r"][0].as_py(), table["b"].to_pylist()
    keys = [np.cumsum(unsqueeze(x, 6), dtype=_U) for x in table["k"].to_pylist()]
    counts = np.concatenate([unsqueeze(x, 4) for x in table["n"].to_pylist()]).astype(np.int64)
    sizes = [len(x) for x in keys]
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
    total = np.empty(len(keys), np.int64)
    total[order] = np.add.reduceat(counts[order], first)[group]
    seen = total > np.minimum(counts, 1)
    ends = np.cumsum(sizes)
    out = [(np.packbits(seen[e - s : e]).tobytes(), squeeze(total[e - s : e][seen[e - s : e]], 5)) for s, e in zip(sizes, ends, strict=True)]
    return pa.table({"b": pa.array(batch, pa.int64()), "r": pa.array([r] * len(out), pa.int32()), "seen": pa.array([x for x, _ in out], pa.binary()), "n": pa.array([x for _, x in out], pa.binary())})


def totals(answers: pa.Table, keys: np.ndarray, bits: int) -> np.ndarray:
    """The corpus-wide count of each of a batch's sorted cut keys; a key with count one in the corpus has 1."""
    out = np.ones(len(keys), np.int64)
    edges = _edges(keys, bits)
    for r, seen, n in zip(answers["r"].to_pylist(), answers["seen"].to_pylist(), answers["n"].to_pylist(), strict=True):
        x, y = edges[r], edges[r + 1]
        on = np.unpackbits(np.frombuffer(seen, np.uint8), count=y - x).astype(bool)
        out[x:y][on] = unsqueeze(n, 5).astype(np.int64)
    return out


def shared_counts(docs: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """The answers, a row for each batch and range, for documents with a batch column ``b``.

    ``keys_of`` gives the uint64 keys of a batch with their counts (keys may repeat).
    """

    def send(table: pa.Table) -> pa.Table:
        keys, counts, _ = cut(*keys_of(table), bits)
        return _send(table["b"][0].as_py(), keys, counts, bits)

    sent = docs.groupBy("b").applyInArrow(send, "r int, b long, k binary, n binary")
    return sent.groupBy("r").applyInArrow(_add, COUNTS)


def shared_counts_of_rows(packed: DataFrame, keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """As ``shared_counts``, for a table each row of which is a batch."""

    def send(batches):
        for part in batches:
            for row in part.to_pylist():
                keys, counts, _ = cut(*keys_of(row), bits)
                yield from _send(row["b"], keys, counts, bits).to_batches()

    return packed.mapInArrow(send, "r int, b long, k binary, n binary").groupBy("r").applyInArrow(_add, COUNTS)
