import hashlib
import re

from lorewell.llm.line_dedup import drop_repeated_lines

from . import fixtures


def brute(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))
    owner = {}
    for d, t, *_ in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 10:
                    owner[key(x)] = min(d, owner.get(key(x), d))
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < 10 or owner[key(x)] == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_matches_brute_force(spark):
    rows = fixtures.rows()
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in drop_repeated_lines(fixtures.docs(spark)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert any(x[3] for x in got)


def test_long_documents_use_many_words_of_the_bitmap(spark):
    lines = [f"line number {i} of the document" for i in range(500)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[100:400] + ["own line of the second"]))]
    got = {r.doc_id: r for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_dropped == 0 and got[2].n_dropped == 300 and got[2].text == "own line of the second"


def test_extra_columns_and_empty_table(spark):
    extra = spark.createDataFrame([(1, "a line of some length", 5, "q")], "doc_id long, text string, n_lines int, words string")
    out = drop_repeated_lines(extra)
    assert out.columns == ["doc_id", "text", "words", "n_lines", "n_dropped"] and out.first().words == "q"
    assert drop_repeated_lines(fixtures.empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = drop_repeated_lines(fixtures.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digest(spark):
    row = drop_repeated_lines(spark.createDataFrame([(1, "é\nshared line one"), (2, "Shared Line One\nz")], "doc_id long, text string")).orderBy("doc_id").collect()[1]
    assert hashlib.sha256(row.text.encode()).hexdigest() == hashlib.sha256(b"z").hexdigest()
