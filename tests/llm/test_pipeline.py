import re

import pytest

import corpus_pipeline as P
from lorewell.llm import quality_rules

from . import fixtures, test_jaccard_join, test_line_dedup, test_packing, test_quality_rules

pytest.importorskip("public_tokenizers")
WORD = r"[^\x20\x09-\x0D]+"


def passes(line):
    """The line rules in plain Python."""
    w = re.findall(WORD, line)
    letters, capitals = len(re.findall("[A-Za-z]", line)), len(re.findall("[A-Z]", line))
    low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    bad = sum(line.count(c) for c in "#*$%&|<>") > 0.3 * len(w) or letters >= 12 and capitals > 0.7 * letters
    bad |= bool(w) and len(w) < 4 and not re.search(r"[.!?:;,\"')\]»”’…。！？；：、）」』]$", w[-1])
    bad |= len(w) <= 40 and any(p.decode() in low for p in quality_rules.FURNITURE)
    return not (w and bad)


def cleaned(rows):
    out = []
    for d, t in rows:
        *_, failed = test_quality_rules.counts(t)
        kept = [x for x in (t or "").split("\n") if passes(x)]
        size = lambda s: sum(map(len, re.findall(WORD, s)))
        if not failed and size("\n".join(kept)) >= 0.5 * size(t or ""):
            out.append((d, "\n".join(kept)))
    return out


def test_stages_against_plain_python(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{fixtures.SMALL}/documents.parquet")
    pairs = lambda frame: sorted((r.doc_id, r.text) for r in frame.collect())
    stages = [f for _, f in P.STAGES]
    one = stages[0](spark, docs, fixtures.SMALL).cache()
    assert pairs(one) == sorted(cleaned(pairs(docs)))
    two = stages[1](spark, one, fixtures.SMALL).cache()
    assert pairs(two) == sorted((d, t) for d, t, _, n in test_line_dedup.brute(pairs(one)) if not n or re.search(WORD, t))
    three = stages[2](spark, two, fixtures.SMALL).cache()
    groups = {d: c for d, _, c in test_jaccard_join.brute(pairs(two), 5, 80)}
    assert pairs(three) == [(d, t) for d, t in pairs(two) if groups[d] == d]
    words = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t)]
    windows = lambda t: list(zip(*[words(t)[k:] for k in range(8)], strict=False))
    items = [windows(r.text) for r in spark.read.parquet(f"{fixtures.SMALL}/benchmark.parquet").collect()]
    four = stages[3](spark, three, fixtures.SMALL).cache()

    def held(text):
        own = set(windows(text))
        return any((n := sum(w in own for w in set(i))) and (n >= 6 or 2 * n >= len(i)) for i in items)

    clean = [(d, t) for d, t in pairs(three) if not held(t)]
    assert pairs(four) == clean
    assert all(f.columns == docs.columns for f in (one, two, three, four))
    assert all(r.n_chars == len(r.text) for r in four.collect())
    test_packing.check(pairs(four), stages[4](spark, four, fixtures.SMALL).collect(), Tokenizer.from_file(test_packing.PATH))


def test_empty_table(spark):
    docs = fixtures.empty(spark)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, fixtures.SMALL)
    assert docs.count() == 0
