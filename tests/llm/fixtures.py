"""A small table of documents that holds the cases every operator must define."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SMALL = "/root/testdata/sf0.001"


def words(rng, n, pool=None):
    pool = pool or [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    return [rng.choice(pool) for _ in range(n)]


def rows(seed=7):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        lines = [" ".join(words(rng, rng.randint(3, 14))).capitalize() + "." for _ in range(rng.randint(1, 9))]
        texts.append("\n".join(lines))
    base = " ".join(words(rng, 120)) + "."
    for k in range(12):
        w = base.split()
        for _ in range(k // 2):
            w[rng.randrange(len(w))] = rng.choice(["new", "edit", "word"])
        texts.append(" ".join(w))
    texts += [base, base.upper(), texts[0], "", " \n\t ", "one", "one two", "one two three four", "Un été à la plage, ça c'est déjà l'été.\nShared line of text here.", "shared LINE of text here.  \nother", "\tShared line of text here.\n\nShared line of text here.", "x" * 5000, " ".join(words(rng, 3000)), "a | b | c | d\n" * 5, "café " * 40]
    out = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    out += [(200, None, None, None, None), (201, base, None, None, None), (201, base, None, None, None), (None, base, "en", None, 3), (None, None, None, None, None)]
    rng.shuffle(out)
    return out


def docs(spark, seed=7, parts=5):
    return spark.createDataFrame(rows(seed), DOCS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DOCS)
