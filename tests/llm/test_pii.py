import random
import re

import pyarrow as pa
import pytest

from lorewell.llm import pii, pii_crf, spans

from . import fixtures

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = [int(c) for c in re.sub("[^0-9]", "", m.group())]
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
            ok |= kind == "phone" and 10 <= len(d) <= 15
            if kind == "card" and 14 <= len(d) <= 19:
                ok = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PLAIN).index(s[2])))


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_match_the_plain_patterns(seed):
    rng = random.Random(seed)
    bits = ["a", "b.c", "@", ".", "1", "22", "255", "256", "4111111111111111", "+", "+1 (743) 555-3824", " ", "-", "_", "é", "x@y.z", "1.2.3.4", "\n", "(", "%", "com", "٣", "0"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 18)))
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000, "a.b" * 70_000 + "@", "1.2" * 70_000, "+1" + " " * 200_000, "1 " * 100_000):
        pii.base_spans(t)


def columns(texts):
    return spans.column_bytes(pa.array(texts, pa.string()))


def test_field_learns_its_table_and_leaves_prose_alone():
    field = pii_crf.trained()
    table = pii_crf.training_table()
    got = field.decode([field.emissions(x[None])[0] for x, _ in table])
    right = sum([pii_crf.LABELS[v] for v in g] == labels for g, (_, labels) in zip(got, table, strict=True))
    assert right >= 0.97 * len(table)
    # None of these lines is in the table.
    texts = ["Please call 444-321-9876 soon.\nMy name is Carla Jones.", "write to bob at work dot com please", "It was 2 of 3 in 2023, about 40 percent.", "Version 3.0 of the License", 'the token = "11dbebab91ab85687d33eeaaf9ac699e1188f9ff" is new', "Last week Emma Watson went home.", "ssn 321-54-9876"]
    found = pii.field_spans(*columns(texts), field)
    assert [[k for *_, k in f] for f in found] == [["phone", "person"], ["email"], [], [], ["secret"], ["person"], ["id"]]
    assert [texts[0][a:b] for a, b, _ in found[0]] == ["444-321-9876", "Carla Jones"]


def brute_tokens(text):
    """Tokens of one line: runs of letters, runs of digits, all others alone."""
    return [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+|\d+|[^\w\s]|_", text)]


def test_tokens_match_a_pattern():
    texts = ["a1b2 é_x — „y“ 12,5\t٣", "", "x\n\ny", "日本 ok", "ÀB c"]
    raw, at = columns(texts)
    t = pii_crf.read(raw, at)
    for i, text in enumerate(texts):
        own = (t.start >= at[i]) & (t.start < at[i + 1])
        data = text.encode()
        assert [data[a - at[i] : b - at[i]].decode() for a, b in zip(t.start[own], t.end[own], strict=True)] == [text[a:b] for a, b in brute_tokens(text)]
        assert len(set(t.line[own])) == len([x for x in text.split("\n") if x.strip()])


def plain_viterbi(field, e):
    """The best labels of one line, in plain Python."""
    k = len(pii_crf.LABELS)
    best = [field.moves[k][j] + e[0][j] for j in range(k)]
    back = []
    for row in e[1:]:
        step = [max(range(k), key=lambda i, j=j: best[i] + field.moves[i][j]) for j in range(k)]
        best = [best[i] + field.moves[i][j] + row[j] for j, i in enumerate(step)]
        back.append(step)
    labels = [max(range(k), key=lambda j: best[j])]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def test_cut_lines_decode_as_whole_lines(spark):
    field = pii_crf.trained()
    texts = [r.text or "" for r in spark.read.parquet(f"{fixtures.SMALL}/documents.parquet").limit(60).collect()]
    texts += ["Mr. Jones and Dr. Anna Keller said 555-123-4567, or 030 1234 5678; ssn 123-45-6789!\ncall\n" * 3, "mail bob at work dot com", 'x token = "9f3ab21c77de00aa55"']
    raw, at = columns(texts)
    t = pii_crf.read(raw, at)
    want = []
    for line in sorted(set(t.line.tolist())):
        own = [i for i, v in enumerate(t.line.tolist()) if v == line]
        labels = plain_viterbi(field, field.emissions(t.x[None][:, :, own])[0].tolist())
        want += [(own[a], own[b - 1] + 1, kind) for kind, a, b in pii_crf.spans_of(labels)]
    assert sorted(field.find(t)) == sorted(want) and len(want) > 8


def test_viterbi_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    k = len(pii_crf.LABELS)
    field = pii_crf.Field([rng.normal(size=(5, n, k)) for n in pii_crf.SIZES], rng.normal(size=(k + 1, k)))
    rows = [np.stack([rng.integers(0, s, n) for s in pii_crf.SIZES]) for n in (1, 2, 3, 4)]
    scores = [field.emissions(x[None])[0] for x in rows]
    for e, labels in zip(scores, field.decode(scores), strict=True):
        score = lambda y: field.moves[k, y[0]] + sum(e[t, v] for t, v in enumerate(y)) + sum(field.moves[a, b] for a, b in itertools.pairwise(y))
        assert tuple(labels) == max(itertools.product(range(k), repeat=len(labels)), key=score)


def test_very_long_texts_and_lines():
    import time

    field = pii_crf.trained()
    for line in ("we met at the old mill again ", "1 2 ab 30 4 ", "Anna Keller at home dot com ", "555-123-4567 "):
        for text in (line * (1_000_000 // len(line)), (line + "\n") * (1_000_000 // len(line))):
            began = time.process_time()
            own = pii.base_spans(text)
            pii.without_overlaps(pii.field_spans(*columns([text]), field)[0], own)
            assert time.process_time() - began < 20, line


def test_overlaps():
    rng = random.Random(4)
    for _ in range(300):
        spans_ = lambda n: sorted((a, a + rng.randint(1, 9), "ip") for a in (rng.randint(0, 40) for _ in range(n)))
        own, more = spans_(rng.randint(0, 4)), spans_(rng.randint(0, 6))
        assert pii.without_overlaps(more, own) == [s for s in more if not any(s[0] < b and a < s[1] for a, b, _ in own)]


def test_query_rows(spark):
    rows = [(1, "mail ann@site.org or 10.0.0.1, card 4111 1111 1111 1111, +1 (743) 555-3824"), (2, None), (3, ""), (None, "x 300.1.1.1")]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_email, out[1].n_ip, out[1].n_card, out[1].n_phone) == (1, 1, 1, 1)
    assert out[1].base == pii.join_spans(brute(rows[0][1])) and out[2].spans == "" == out[3].base
    assert pii.find_pii(fixtures.empty(spark)).count() == 0


def test_small_table(spark):
    docs = spark.read.parquet(f"{fixtures.SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    added = []
    for r in pii.find_pii(docs).collect():
        assert r.base == pii.join_spans(brute(texts[r.doc_id]))
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        added += [s.split(":")[0] for s in set(r.spans.split(",")) - set(r.base.split(","))]
        assert r.n_spans == len(list(filter(None, r.spans.split(",")))) and r.n_base == len(list(filter(None, r.base.split(","))))
    assert sum(k != "secret" for k in added) <= 2
