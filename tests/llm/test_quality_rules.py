import re

from lorewell.llm.quality_rules import keep_clean, quality_report

from . import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(w) - 4):
        where.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_base_counts_match_brute_force(spark):
    want = sorted(((d, *counts(t)) for d, t, *_ in fixtures.rows()), key=str)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_report(fixtures.docs(spark)).collect()), key=str)
    assert got == want


def test_base_counts_match_on_the_small_table(spark):
    table = spark.read.parquet(f"{fixtures.SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in quality_report(table).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(texts[r.doc_id])


def test_line_rules(spark):
    good = "This is a plain sentence of many words that ends as it should."
    other = "Here a different thing is said, at about equal length, in calm words."
    rows = [
        (1, good),
        (2, good + "\nHome | About | Contact | Help\n" + other),
        (3, "Home | About | News | Sports | Mail | Shop | Help | Login | Cart | Top"),
        (4, "STOP!! READING!! THIS!! VERY!! LOUD!! TEXT!! OF!! MANY!! CAPITAL!! LETTERS!!\n" + "short line."),
        (5, good + "\nPlease read our Cookie Policy first."),
        (6, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality_report(frame).collect()}
    assert kept == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False}
    texts = {r.doc_id: r.text for r in keep_clean(frame).collect()}
    assert texts == {1: good, 2: good + "\n" + other, 5: good}


def test_rejects_marked_documents_and_keeps_the_others(spark):
    docs = spark.read.parquet(f"{fixtures.SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{fixtures.SMALL}/labels.parquet")
    both = quality_report(docs).join(labels, "doc_id").select("kept", "base_failed", "quality").collect()
    # The base fails marked-good documents of under ten words or of much repetition.
    good = [r.kept for r in both if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in both if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_empty_table_and_columns(spark):
    assert quality_report(fixtures.empty(spark)).count() == 0
    assert keep_clean(fixtures.docs(spark)).columns == fixtures.DOCS.names
