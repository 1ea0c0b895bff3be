import fnmatch
import random

import pytest

from lorewell.llm.queries import oracle_sql
from lorewell.llm.url_filter import BLOCK_GLOBS, HOST_RULES, Automaton, canonical, judge_urls, parts

from ..oracle import normal


@pytest.mark.parametrize("seed", range(6))
def test_automaton_matches_fnmatch(seed):
    rng = random.Random(seed)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(0, 40 if seed else 4))) for _ in range(30)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    got = Automaton([g.encode() for g in globs]).match([t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        # A rule without characters fits nothing.
        assert row.tolist() == [bool(g) and fnmatch.fnmatchcase(t, g) for g in globs]


def test_parts():
    assert parts("HTTPS://WWW.Éx.COM?x/y") == ("www.Éx.com", "")
    assert parts("a://h/p/q?x#y") == ("h", "/p/q")
    assert parts("a://h#f?/x") == ("h", "")
    assert parts("no url") == parts(None) == parts("") == ("", "")
    assert parts("x://y://z/") == ("y:", "//z/")


def test_rules_against_plain_python(spark):
    rng = random.Random(3)
    hosts = ["com", "example.com", "WWW.example.com", "xcom", "a.net", "example.net", "net", "b.example.net", "org", "o.org", "spam-farm.dev", "com.de", ""]
    paths = ["/en/7", "/en/", "/EN/7", "/en", "/de/8x", "/de/9", "/es/", "/x.com/en/7", "", "/en/7" + "z" * 3000]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/en/', '#x'])}") for i in range(400)] + [(400, None), (401, "plain"), (None, "http://com/en/"), (3, "http://com/en/")]

    def plain(url):
        h, p = parts(url)
        fit = [(len(a + b), a + b, v) for v, a, b in HOST_RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return (h, p, *max(fit)[1:]) if fit else (h, p, None, "block" if h.startswith("spam") else "allow")

    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(4)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, str(x))
    assert sorted(got, key=key) == sorted([(i, *plain(u)) for i, u in rows], key=key)


def test_rules_of_the_contract(spark):
    urls = ["http://com/en/1", "https://a.example.com/en/7x", "http://example.com/en/8", "http://a.net/de/8", "ftp://WWW.Example.NET/de/8?q", "http://example.net/de/9", "http://x.org/es/", "http://casino.net/de/"]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {0: ("com/en/", "block"), 1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("net/de/", "allow"), 6: ("org/es/", "block"), 7: ("net/de/", "allow")}


def test_canonical():
    assert canonical("me@www.spam.com:8080", "/A//b/%43%2f%7Ex%zz%") == ("www.spam.com", "/a/b/c%2f~x%zz%")
    assert canonical("host..", "") == ("host", "") and canonical("", "//") == ("", "/")
    assert canonical("h", "/%2541%%341") == ("h", "/%2541%41")


def test_odd_urls_equal_the_sql(spark):
    import duckdb

    rng = random.Random(8)
    hosts = ["com", "u:p@ads.x.com:80", "Casino.net.", "a.banner12.org", "h", "x.spam-y.z", "my-poker.io:"]
    paths = ["", "/", "/LOGIN", "/%6cogin/x", "//wp%2dlogin", "/a.EXE", "/a.ex%65", "/%", "/%4", "/%2541", "/cart//", "/en/7", "/é%C3%A9.png"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?x.exe', '#y'])}") for i in range(300)] + [(300, None), (301, "://"), (302, "a://b")]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = [normal(r) for r in con.sql(oracle_sql()["op5_url_filter"]).fetchall()]
    assert sorted(map(list, got)) == sorted(want)
    assert {v for *_, v in got} == {"allow", "block"} and len(BLOCK_GLOBS) > 40
    # Against each glob alone, in plain Python.
    for (_, url), (_, host, path, rule, verdict) in zip(rows, sorted(got), strict=True):
        h, p = canonical(*parts(url))
        fits = any(fnmatch.fnmatchcase("." + h, a) and fnmatch.fnmatchcase(p, b) for a, b in (g.split("|") for g in BLOCK_GLOBS))
        assert (host, path) == parts(url) and (rule is not None or verdict == ("block" if fits else "allow"))


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
