import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorewell.llm.lm_scoring import BACKOFF, score_language_model, score_relational

from . import fixtures


def brute(rows, order):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, *_ in rows]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    every, total = Counter(), sum(map(len, texts))
    for w in texts:
        every.update(grams(w))
    out = []
    for (d, *_), w in zip(rows, texts, strict=True):
        own, score, levels = grams(w), 0.0, Counter()
        seen = lambda g: every[g] - own[g]
        for i in range(len(w)):
            top = min(order, i + 1)
            for k in range(top, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if seen(g):
                    score += math.log(seen(g) / (seen(g[:-1]) if k > 1 else total - len(w))) + (top - k) * math.log(BACKOFF)
                    levels[k] += 1
                    break
            else:
                score += math.log(0.5 / max(1, total - len(w))) + top * math.log(BACKOFF)
                levels[0] += 1
        out.append((d, len(w), *[levels[k] for k in (*range(1, order + 1), 0)], round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [3, 2])
def test_matches_brute_force(spark, order):
    got = score_language_model(fixtures.docs(spark), order).drop("mean_log_score").collect()
    assert sorted(((*r[:-1], round(r[-1], 6)) for r in got), key=str) == brute(fixtures.rows(), order)


@pytest.mark.parametrize("order", [3, 1])
def test_rows_and_batches_score_alike(spark, order):
    docs = fixtures.docs(spark)
    rounded = lambda frame: sorted(map(str, (r.asDict() for r in frame.withColumn("log_score", F.round("log_score", 6)).withColumn("mean_log_score", F.round("mean_log_score", 6)).collect())))
    rows, batches = score_relational(docs, order), score_language_model(docs, order)
    assert rows.columns == batches.columns and rounded(rows) == rounded(batches)
    assert score_relational(fixtures.empty(spark), order).count() == 0


def test_empty_table_and_lone_document(spark):
    assert score_language_model(fixtures.empty(spark)).count() == 0
    row = score_language_model(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0].n_unseen == 2 and row[1].log_score == 0 and row[1].mean_log_score is None
