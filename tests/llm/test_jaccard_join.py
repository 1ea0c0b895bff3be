import random
import re
from itertools import combinations

import pytest

from lorewell.llm import jaccard_join
from lorewell.llm.jaccard_join import shingle_components

from . import fixtures


def brute(rows, n, percent):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out, sets, up = [], {}, {}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        s = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
        out.append((d, len(s)))
        if d is not None:
            up[d] = d
            sets.setdefault(s, set()).add(d)
    pairs = [(min(a), x) for s, a in sets.items() if s for x in a]
    reps = [(s, min(a)) for s, a in sets.items() if s]
    for (s, a), (t, b) in combinations(reps, 2):
        both = len(s & t)
        if both and 100 * both >= percent * (len(s) + len(t) - both):
            pairs.append((a, b))
    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return sorted(((d, k, None if d is None else top(d)) for d, k in out), key=str)


def result(frame, n, percent):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in shingle_components(frame, n, percent).collect()), key=str)


def test_fixture_table(spark):
    assert result(fixtures.docs(spark), 4, 85) == brute(fixtures.rows(), 4, 85)


@pytest.mark.parametrize(("percent", "block"), [(85, 128), (60, 8)])
def test_groups_of_near_copies(spark, monkeypatch, percent, block):
    """Copies of copies and shared edits: hubs link a part only, the rest must be found across."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng, rows = random.Random(11), []
    for g in range(4):
        base = fixtures.words(rng, 60 + 30 * g, [f"w{i}" for i in range(400)])
        group = [base]
        for _ in range(70):
            w = list(rng.choice(group[-8:] if g % 2 else group[:3]))
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], ["edit"], [w[i], "more"]])
            group.append(w)
        rows += [" ".join(w) for w in group]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute(rows, 4, percent)
    assert 4 < len({c for *_, c in want}) < len(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 4, percent) == want


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_that_share_much_but_not_enough(spark, monkeypatch, percent):
    """Texts of one common part and own words link only where they share own words, too."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng, base = random.Random(12), fixtures.words(random.Random(3), 60, [f"c{i}" for i in range(500)])
    rows = []
    for k in range(120):
        own = [f"o{k}_{i}" for i in range(rng.choice([6, 9, 14]))]
        rows.append(base + own)
        if k % 6 == 0:
            rows.append(base + own[:-1] + [f"p{k}"])
        if k % 9 == 0:
            rows.append(base[: rng.randint(40, 60)] + own)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want = brute(rows, 4, percent)
    assert 20 < len({c for *_, c in want}) < len(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, percent) == want


def test_rows_of_one_id_are_one_node(spark):
    a, b = " ".join(map(str, range(50))), " ".join(map(str, range(100, 160)))
    rows = [(5, a), (5, b), (3, a), (9, b), (7, "alone here")]
    assert {d: c for d, _, c in result(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)} == {5: 3, 3: 3, 9: 3, 7: 7}


def test_empty_table(spark):
    assert shingle_components(fixtures.empty(spark)).count() == 0
