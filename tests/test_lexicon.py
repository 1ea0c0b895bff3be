"""The lexicon: tokens, compilation, spans and canonical JSON, by their acceptance cases."""

import json
import random
import unicodedata

import pytest

from lorewell.operators import lexicon
from lorewell.operators.lexicon import Alias, Matcher, compile_lexicon, findings, match_texts, match_tokens, norm_token, pieces, report, tokenize

ROWS = [
    Alias(1, "pub:proc.galvanising", "galvanising"),
    Alias(2, "pub:proc.galvanising", "galvanizing", 0.85, alias_type="variant"),
    Alias(3, "pub:defect.brittle_fracture", "brittle fracture"),
    Alias(4, "pub:defect.fracture", "fracture"),
    Alias(5, "pub:mat.polyethylene", "PE", 0.8, "caps", False, "abbrev"),
    Alias(6, "pub:phys.potential_energy", "PE", 0.8, "caps", False, "abbrev"),
    Alias(7, "pub:alloy.inconel", "inconel", fuzzy_allowed=False),
    Alias(8, "pub:test.brinell_hardness", "Brinell hardness"),
    Alias(9, "pub:defect.cold_work_marks", "cold work marks", 0.7, alias_type="informal"),
]


@pytest.fixture(scope="module")
def matcher():
    found, lexicon = compile_lexicon(ROWS)
    assert not found and len(lexicon.version) == 64
    return Matcher(lexicon)


def test_tokens_and_forms():
    words = lambda t: [w for w, *_ in tokenize(t)]
    assert [words(t) for t in ("Cold-work", "0.5", "1,000", ".5", "H2O/CO2", "Brinell's", "a.b 1.")] == [["Cold", "work"], ["0.5"], ["1,000"], ["5"], ["H2O", "CO2"], ["Brinell's"], ["a", "b", "1"]]
    assert (norm_token("Brinell's"), norm_token("'s"), norm_token("Straße")) == ("brinell", "", "strasse")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Cold-work marks after galvanising.", [("Cold-work marks", 9, 0.7), ("galvanising", 1, 1.0)]),
        ("Query PE.", [("PE", 5, 0.8)]),
        ("made of pe", []),
        ("hot galvenising", [("galvenising", 1, 0.8)]),
        ("cast inconl", []),
        ("brittle fracture observed", [("brittle fracture", 3, 1.0)]),
        ("Brinell's hardness", [("Brinell's hardness", 8, 1.0)]),
        ("", []),
    ],
)
def test_spans(matcher, text, want):
    assert [(text[a:b], alias, score) for a, b, _, alias, score in matcher.match(text)] == want


def test_canonical_json(matcher):
    got = json.loads(matcher.match_json("cast inconl"))
    assert got["flags"] == [{"type": "fuzzy_suppressed", "stage": "token", "token_index": 1, "nearest": "inconel", "distance": 1}] and got["unmatched_token_indices"] == [0, 1]
    version = matcher.lexicon.version
    want = (
        '{"matcher_version":"1.0.0","lexicon_version":"' + version + '","norm_version":"NORM-1","tok_version":"TOK-1","text":"hot galvenising",'
        '"tokens":[{"i":0,"surface":"hot","norm":"hot","char_start":0,"char_end":3,"corrected_from":null,"edit_distance":0},'
        '{"i":1,"surface":"galvenising","norm":"galvanising","char_start":4,"char_end":15,"corrected_from":"galvenising","edit_distance":1}],'
        '"spans":[{"span_id":0,"tok_start":1,"tok_end":2,"char_start":4,"char_end":15,"surface_original":"galvenising","matched_norm":"galvanising","fuzzy":true,'
        '"candidates":[{"alias_id":1,"node_id":"pub:proc.galvanising","alias_type":"preferred","weight":1.0000,"score":0.8000}]}],"unmatched_token_indices":[0],"flags":[]}'
    )
    assert matcher.match_json("hot galvenising").decode() == want
    both = json.loads(matcher.match_json("Query PE."))["spans"][0]["candidates"]
    assert [(c["alias_id"], c["node_id"]) for c in both] == [(5, "pub:mat.polyethylene"), (6, "pub:phys.potential_energy")]
    assert json.loads(matcher.match_json(""))["tokens"] == []


def test_refused_inputs(matcher):
    for bad, code in ((123, "E_INVALID_INPUT"), ("x\ud800y", "E_INVALID_INPUT"), ("a" * 4097, "E_INPUT_TOO_LONG")):
        with pytest.raises(ValueError, match=code):
            matcher.match(bad)


def test_compilation_finds_all(matcher):
    bad = [
        Alias(201, "pub:x1", "pe"),
        Alias(202, "pub:x1", "the"),
        Alias(203, "pub:ghost", "ghostterm"),
        Alias(204, "pub:x1", "flange", norm_seq="wrongseq", n_tokens=1),
        Alias(205, "pub:x1", "'s"),
        *[Alias(210 + i, f"pub:a{i}", "amb") for i in range(1, 6)],
        Alias(216, "pub:a6", "amb", origin="user"),
    ]
    nodes = {"pub:x1", *[f"pub:a{i}" for i in range(1, 7)]}
    codes = {(level, code) for level, code, _ in findings(bad, nodes)}
    assert codes == {("ERROR", "C1"), ("ERROR", "C2"), ("ERROR", "C3"), ("ERROR", "C4"), ("ERROR", "EMPTY_NORM"), ("WARN", "AMBIGUOUS_NORM"), ("WARN", "ORIGIN_SHADOW")}
    assert compile_lexicon(bad, nodes)[1] is None and json.loads(report(bad, nodes))["counts"]["errors"] >= 5
    assert findings([Alias(1, "n", "x" * 5, status="retired", case_mode="odd")]) == []
    vocabulary = matcher.lexicon.vocabulary
    assert vocabulary["galvanising"][2] == "targetable" and vocabulary["inconel"][2] == "suppressed" and vocabulary["pe"][2] == "none" and vocabulary["fracture"][1] == 2


def test_texts_of_any_length(spark):
    text = "pad words " * 500 + "brittle fracture " + "more " * 900 + "galvanising"
    assert "".join(p for _, p in pieces(text)) == text and pieces("") == [] and all(len(p) <= 4096 for _, p in pieces("x" * 9000))
    got = match_texts(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), ROWS, "id").collect()
    assert [(r.id, text[r.start : r.end], r.alias_id) for r in got] == [(1, "brittle fracture", 3), (1, "galvanising", 1)]
    with pytest.raises(ValueError, match="compile"):
        match_texts(spark.createDataFrame([(1, "x")], "id long, text string"), [Alias(1, "n", "the")], "id")


def test_token_windows_of_any_size(spark):
    tokens = spark.createDataFrame([(1, list("abcdefghij")), (2, [])], "id long, tokens array<string>")
    aliases = spark.createDataFrame([(n, list("abcdefghij")[1 : 1 + n]) for n in range(1, 9)], "alias_id long, seq array<string>")
    assert sorted((r.id, r.pos, r.alias_id) for r in match_tokens(tokens, aliases).collect()) == [(1, 1, n) for n in range(1, 9)]
    with pytest.raises(ValueError, match="tokens"):
        match_tokens(tokens, spark.createDataFrame([(1, list("abcdefghi"))], "alias_id long, seq array<string>"))


def plain_osa(a, b):
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            row.append(min(best, two[j - 2] + 1) if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y else best)
        two, one = one, row
    return one[-1]


def test_edits_equal_the_table_of_distances():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(0, 10)))
    for a, b in [("", ""), ("", "ab"), ("ab", ""), *((word(), word()) for _ in range(5000))]:
        assert lexicon.osa(a, b) == plain_osa(a, b), (a, b)


def test_tokens_are_runs_of_letters_numbers_and_apostrophes():
    inside = lambda t, i: t[i] in "'’" or unicodedata.category(t[i])[0] in "LN" or t[i] in ".," and all(0 <= k < len(t) and unicodedata.category(t[k]) == "Nd" for k in (i - 1, i + 1))
    rng = random.Random(6)
    for _ in range(5000):
        t = "".join(rng.choice("a1.,'’ _é٣½²一-…Ⅷ\n\u0301") for _ in range(rng.randint(0, 12)))
        on = [i for i in range(len(t)) if inside(t, i)]
        starts, ends = [i for i in on if i - 1 not in on], [i + 1 for i in on if i + 1 not in on]
        assert lexicon.tokenize(t) == [(t[a:b], a, b) for a, b in zip(starts, ends, strict=True)], t


def test_words_that_differ_too_much_in_length_are_not_compared(monkeypatch):
    """A new word is held against few words of the lexicon, and a form is not looked for beyond the last token."""
    matcher = lexicon.Matcher(lexicon.compile_lexicon([lexicon.Alias(1, "a", "station"), lexicon.Alias(2, "b", "station house"), lexicon.Alias(3, "c", "stationmaster")])[1])
    seen = []
    monkeypatch.setattr(lexicon, "osa", lambda a, b, own=lexicon.osa: seen.append((a, b)) or own(a, b))
    assert matcher.match("the statoin") == [(4, 11, "a", 1, 0.8)]
    assert seen == [("statoin", "station")]
    assert matcher.match("the station") == [(4, 11, "a", 1, 1.0)]


def test_passages_are_found_by_all_their_words(spark, tmp_path):
    """A document with the end of a passage alone has its runs of three words; short passages are aliases, too, where a lexicon takes them."""
    from lorewell.plans import catalog

    passages = [(1, "some ordinary beginning then rusting harbour cranes"), (2, "Bo's"), (3, "Lantern glass"), (4, None), (5, "the"), (6, "one two three, one two three")]
    texts = [(10, "old rusting harbour cranes"), (11, "then rusting harbuor cranes"), (12, "lantern  glass, bo the"), (13, None), (14, "two three one two three")]
    for name, rows, columns in (("benchmark", passages, "item_id long, text string"), ("documents", texts, "doc_id long, text string")):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / f"{name}_rows"))
        next((tmp_path / f"{name}_rows").glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    text = dict(texts)
    found = catalog.queries()["lexicon_spans"](spark, str(tmp_path)).collect()
    got = sorted((r.doc_id, text[r.doc_id][r.start : r.end], r.node_id, r.score) for r in found)
    assert got == [(10, "rusting harbour cranes", "n1", 1.0), (11, "then rusting harbuor", "n1", 0.8), (12, "lantern  glass", "n3", 1.0), (14, "two three one", "n6", 1.0)]
    assert lexicon.runs("one two three, one two three", 3) == ["one two three", "two three one", "three one two"] and lexicon.runs(" ' ", 3) == []


def test_nearest_words_equal_brute_force():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 11))) for _ in range(400)})
    matcher = lexicon.Matcher(compile_lexicon([Alias(i, "n", w) for i, w in enumerate(words) if len(w) > 2])[1])
    for _ in range(600):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(4, 11)))
        most = 1 if len(w) <= 6 else 2
        far = {x: plain_osa(w, x) for x in words if len(x) >= 4}
        least = min(far.values())
        want = (least, {x for x in far if far[x] == least}) if least <= most else (0, set())
        got = matcher._nearest(w)
        assert (got[0], set(got[1])) == want, w
