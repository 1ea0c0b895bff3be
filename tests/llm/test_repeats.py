import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import repeats
from lorewell.llm.anchors import anchors

from . import fixtures

N = repeats.LENGTH


def brute(rows):
    owner = {}
    for d, t in rows:
        x = (t or "").encode()
        if d is not None:
            for i in range(len(x) - N + 1):
                owner[x[i : i + N]] = min(d, owner.get(x[i : i + N], d))
    out = []
    for d, t in rows:
        x = (t or "").encode()
        gone = [False] * len(x)
        if d is not None:
            for i in range(len(x) - N + 1):
                if owner[x[i : i + N]] < d:
                    gone[i : i + N] = [True] * N
        spans = sum(g and not b for g, b in zip(gone, [False, *gone]))
        out.append((d, len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(frame).collect()), key=str)


def passages(seed, n=120):
    rng = random.Random(seed)
    pool = [" ".join(fixtures.words(rng, rng.randint(8, 40))) for _ in range(12)] + ["ab" * 60, "x" * 130, "\0" * 90 + "y", "été à la plage " * 6]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(pool)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            parts += [p if rng.random() < 0.4 else p[a:b], " ".join(fixtures.words(rng, rng.randint(0, 9)))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("hot", [20_000, 3])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = [(i * 7 % 101, t) for i, t in enumerate(passages(1))] + [(-5, "x" * 49), (-6, "x" * 50), (500, "x" * 51), (None, "ab" * 60), (None, None), (501, None), (502, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).select("*", *[F.lit("v").alias(c) for c in ("id", "b", "ids", "sizes", "bytes")])
    want = brute(rows)
    assert got(frame) == want and sum(x[2] > 0 for x in want) > 50 and max(x[3] for x in want) > 2


def test_documents_of_the_fixture(spark):
    rows = [(r[0], r[1]) for r in fixtures.rows()]
    assert got(fixtures.docs(spark)) == brute(rows)


def test_maximal_repeats_have_all_occurrences(spark):
    rng = random.Random(3)
    a, b = ("".join(rng.choice("abcdefghij") for _ in range(70)) for _ in range(2))
    rows = [(1, "p" + a + "q"), (2, "r" + a + "s"), (3, "t" + a[5:] + "u"), (4, b + "v" + b), (5, "w" * 20)]
    found = {}
    for r in repeats.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        found.setdefault((r.repeat, r.length), set()).add((r.doc_id, r.start))
    text = dict(rows)
    for (_, n), members in found.items():
        strings = {text[d][i : i + n] for d, i in members}
        assert len(strings) == 1 and n >= N
        s = strings.pop()
        assert members == {(d, i) for d, t in rows for i in range(len(t) - n + 1) if t[i : i + n] == s}
    covered = lambda d: {j for (_, n), m in found.items() for e, i in m if e == d for j in range(i, i + n)}
    assert covered(1) == set(range(1, 71)) and covered(3) == set(range(1, 66)) and covered(4) == set(range(70)) | set(range(71, 141)) and not covered(5)


def test_stack_scan_equals_brute_force():
    rng = random.Random(5)
    width = 2 * N - 24
    base = "".join(rng.choice("ab") for _ in range(width))
    texts = sorted({base[:k] + rng.choice("abc") + base[k + 1 :] for k in range(width)} | {base, base[3:], base[:60]})
    raw, sizes = np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(t) for t in texts])
    of, place, common, before = repeats.suffixes(raw, np.cumsum(sizes) - sizes, sizes)
    got = {(n, frozenset(zip(of[a:b].tolist(), place[a:b].tolist()))) for n, a, b in repeats.intervals(common, before)}
    where = {}
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a + N, len(t) + 1):
                where.setdefault(t[a:b], set()).add((i, a))
    want = set()
    for s, at in where.items():
        left = {texts[i][a - 1] if a else (i, a) for i, a in at}
        right = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else (i, a) for i, a in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            want.add((len(s), frozenset(at)))
    assert got == want and len(want) > 20


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 300, np.uint8)
    a, b = (np.r_[rng.integers(97, 123, n, np.uint8), shared, rng.integers(97, 123, 40, np.uint8)] for n in (17, 400_000))
    pa_, ka = anchors(a, np.array([0, len(a)]), N)
    pb, kb = anchors(b, np.array([0, len(b)]), N)
    inside = lambda p, k, first: {(int(x) - first, int(y)) for x, y in zip(p, k) if first + 26 <= x <= first + 300 - N}
    assert inside(pa_, ka, 17) == inside(pb, kb, 400_000) != set()
    assert len(anchors(a[:49], np.array([0, 49]), N)[0]) == 0


def test_long_text_and_empty_table(spark):
    assert got(fixtures.empty(spark)) == []
    rng = random.Random(9)
    long = " ".join(fixtures.words(rng, 500_000, [f"w{i}" for i in range(90_000)]))
    rows = [(1, long), (2, "Here: " + long[1000:200_000]), (3, "x" * 1_000_000), (4, "x" * 60)]
    out = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].n_removed == 0 and out[3].n_removed == 0 and out[4].n_removed == 60
    assert bytes(out[2].kept).startswith(b"Here: ") and out[2].n_removed >= 198_990 and out[2].n_spans == 1
