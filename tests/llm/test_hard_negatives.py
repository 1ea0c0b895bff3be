import math
import random

import pytest
from pyspark.sql import functions as F

from lorewell.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"
ANCHOR = "vec_id % 4 = 0"


def brute(rows, positives=5, negatives=10):
    ok = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in ok or (label, v) < ok[i]:
            ok[i] = (label, v)
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in ok.items()}
    out = []
    for a in (i for i in q if i % 4 == 0):
        score = {i: sum(x * y for x, y in zip(q[a][1], q[i][1])) for i in q if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if q[i][0] == q[a][0]][:positives]:
            fits = [i for i in order if q[i][0] != q[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:negatives])]
    return sorted(out)


def table(seed=3, n=400, width=70):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in centre[i % 4]], rng.randrange(3)) for i in range(n)]
    rows += [(n + i, rows[7][1], i % 3) for i in range(60)]  # one vector, many times
    rows += [(rows[3][0], rows[3][1], 2), rows[5], rows[5], (None, rows[1][1], 1), (901, None, 1), (902, rows[0][1], None), (903, [0.1, None], 1), (904, [math.nan], 1), (908, [math.inf] * width, 1), (912, [], 1), (916, [0.5, -0.25], 2), (-8, rows[2][1], 0)]
    rng.shuffle(rows)
    return rows


def got(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(tuple(r) for r in H.hard_negatives(frame.select("*", *[F.lit("v").alias(c) for c in ("id", "vector", "anchor", "i", "j", "rank", "positives")]), F.expr(ANCHOR), **more).collect())


@pytest.mark.parametrize("block", [1 << 15, 64])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    rows = table()
    want = brute(rows)
    assert len(want) > 500 and got(spark, rows) == want


def test_grid_of_many_groups_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(H, "CELL_ROWS", 50)
    monkeypatch.setattr(H, "CELL_ANCHORS", 20)
    rows = table(seed=4)
    assert got(spark, rows) == brute(rows)


def test_wide_numbers_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-4e6, 4e6) for _ in range(3)], i % 2) for i in range(60)] + [(61, [1e300, 0.0, -1e300], 1), (63, [3e9] * 3, 0)]
    long = [r for r in brute(rows) if max(abs(r[4]), abs(r[5])) < 1 << 63]
    assert long and [r for r in got(spark, rows) if max(abs(r[4]), abs(r[5])) < H._LONG] == long


def test_empty_tables(spark):
    assert got(spark, []) == [] and got(spark, [(4, None, None)] * 3) == [] and got(spark, [(4, [1.0], 1)]) == []


def test_planes_give_the_numbers_back():
    import numpy as np

    x = np.array([[-5, 3, 0], [7, -8, 2]])
    p = H.planes(x, 3, 1)
    bits = np.unpackbits(p.view(np.uint8).reshape(4, 1, 2, 8), axis=-1, bitorder="little")[:, 0, :, :3].astype(int)
    assert (np.tensordot(H.weights(3), bits, 1) == x).all()


def test_rows_go_before_all_planes_are_read(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    block = H.Rows(np.arange(2000), np.zeros(2000, int), rng.integers(-128, 128, (2000, 64)), 7, 1)
    anchor = rng.integers(-128, 128, 64)
    best, read, keep = H.Best(5), [], None
    steps = block.intervals(H.planes(anchor[None], 7, 1)[:, :, 0:1].reshape(8, 1), np.arange(2000), H.weights(7), (int(np.minimum(anchor, 0).sum()), int(np.maximum(anchor, 0).sum())), np.int64)
    while True:
        try:
            at, low, high = steps.send(keep)
        except StopIteration:
            break
        read.append(len(at))
        keep = best.may(low, high)
    assert read[0] == 2000 and read[-1] < 100 and sum(read) < 0.6 * 2000 * 8
