import random
from collections import defaultdict

import regex

from lorewell.llm.decontaminate import FULL_FIXED, MIN_FIXED, MIN_SHARE, MIN_WINDOWS, UNITS, WINDOW, contaminated, drop_contaminated, mark_contaminated

from . import fixtures

ITEM = "Anna has 12 apples and gives Boris 5 apples, then Boris walks 3 km to the market with Anna and they sell the rest"
OTHER = "the quick brown fox jumps over the lazy dog while a cat looks on from under the old wooden table by the door"


def run(spark, docs, items=((1, ITEM), (2, OTHER), (3, "too short"), (None, OTHER), (4, None))):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {r.doc_id: r.items for r in mark_contaminated(frame, bench).collect()}


def test_exact_reparameterised_and_clean(spark):
    new = ITEM.replace("Anna", "Clara").replace("Boris", "David").replace("12", "40").replace("5 apples", "7 apples").replace("3 km", "9 miles")
    mixed = ITEM.replace("gives Boris", "gives Clara").replace("Anna and they", "Zoe and they").replace("12", "4").replace("then Boris", "then Emil")
    docs = ["Before that, " + ITEM + " again.", "So said they: " + new, "So said they: " + mixed, "x " + OTHER.upper() + " y", OTHER[:30], "", None, "too short", "A plain text of other words, with 3 km and Anna in it, which nobody asked about in any test at all."]
    got = run(spark, docs)
    assert got == {0: [1], 1: [1], 2: [], 3: [2], 4: [], 5: [], 6: [], 7: [], 8: []}


def test_one_consistent_copy_beside_others(spark):
    new = ITEM.replace("Anna", "Clara").replace("Boris", "David").replace("12", "40").replace("5 apples", "7 apples").replace("3 km", "9 miles")
    other = ITEM.replace("Anna", "Emma").replace("Boris", "Frank").replace("12", "31").replace("5 apples", "8 apples").replace("3 km", "6 yards")
    gap = " and so on for a long while, until nothing else was left to say about any of it at all, as we know "
    start = lambda t, n: " ".join(t.split()[:n])
    inserted = new.replace("to the market", "over to the old market")
    docs = ["See: " + start(other, 12) + gap + new, "See: " + start(ITEM, 10) + gap + new, "See: " + new + gap + other, "See: " + start(other, 12) + gap + inserted, "See: " + start(other, 12) + gap + start(new, 10)]
    assert run(spark, docs) == {0: [1], 1: [1], 2: [1], 3: [1], 4: []}


def test_short_items_sentence_names_and_whole_numbers(spark):
    items = [(1, "What is the capital of France?"), (2, "Ann has 3 pens. Ann buys 4. Ben has 5 pens. Ben sells 2. Ann wins."), (3, "A shop sold 750 cups at a price of 3 euros and then 20 plates"), (4, "Paris")]
    docs = ["Quiz: what is the capital of France? Nobody knew.", "So: Eve has 7 pens. Eve buys 9. Tom has 6 pens. Tom sells 1. Eve wins.", "So: Eve has 7 pens. Tom buys 9. Eve has 6 pens. Tom sells 1. Amy wins.", "Then a shop sold 1,500 cups at a price of 2.5 euros and then 40 plates.", "The capital of France is a city", "in Rome", "to paris"]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r["items"] for r in contaminated(frame, bench, short_items=True).collect()}
    assert got == {0: [1], 1: [2], 3: [3], 6: [4]}


def views(text):
    """(words, placeholders or words) of a text, in plain Python."""
    text = regex.sub(r"(?<=[0-9]),(?=[0-9])", "", regex.sub(r"(?<=[0-9])\.(?=[0-9])", "\x01", text))
    out = []
    for w in regex.findall(r"[\p{L}\p{N}\x01]+", text):
        kind = "N" if regex.match(r"\p{Lu}\p{Ll}", w) else "#" if w[0] in "0123456789" else "U" if out and out[-1][1] == "#" and w.lower() in UNITS else None
        out.append((w.lower(), kind or w.lower()))
    return out


def held(doc, item):
    """Is an item in a document, by the docstring of the operator."""
    a, b = views(doc), views(item)
    n = min(WINDOW, len(b))
    windows = lambda v, k: [tuple(x[k] for x in v[i : i + n]) for i in range(len(v) - n + 1)]
    own = [windows(a, k) for k in (0, 1)]
    places = [windows(b, k) for k in (0, 1)]
    floor = FULL_FIXED if n == WINDOW else MIN_FIXED
    places[1] = [w if sum(x not in ("N", "#", "U") for x in w) >= floor else None for w in places[1]]
    enough = lambda c: c >= MIN_WINDOWS or c >= MIN_SHARE * max(1, len(b) - n + 1)
    literal = {p for p, w in enumerate(places[0]) if w in own[0]}
    if enough(len(literal)) and literal:
        return True
    hits = sorted((q, p) for p, w in enumerate(places[1]) for q, x in enumerate(own[1]) if w == x)
    copies, run = defaultdict(set), 0
    for i, (q, p) in enumerate(hits):
        run += i > 0 and q - hits[i - 1][0] >= 2 * WINDOW
        copies["a", q - p].add((q, p))
        copies["r", run].add((q, p))
    for p in {p for _, p in hits}:
        copies["f", 0].add((min(q for q, x in hits if x == p), p))
    for copy in copies.values():
        slots = {(b[p + k][0], a[q + k][0], a[q + k][1]) for q, p in copy for k in range(n) if a[q + k][1] in ("N", "#", "U")}
        if len({s[0::2] for s in slots}) == len(slots) == len({s[1:] for s in slots}) and enough(len({p for _, p in copy} - literal) + len(literal)):
            return True
    return False


def test_template_copies_match_brute_force(spark):
    rng = random.Random(11)
    items = [ITEM, "Tom buys 3 pens at 2.50 dollars each and Ann buys 1,200 pens at 2 dollars each. How much do Tom and Ann pay in all?", "Ann has 3 pens. Ann buys 4. Ben has 5 pens. Ben sells 2. Ann wins.", "Walk 5 km to see Rome today"]
    names, others = ["Anna", "Boris", "Tom", "Ann", "Ben", "Rome", "Eve", "Kim", "Zoe"], ["so it was", "and then", "nobody knew, of course, what else", "In the end"]

    def copy(item):
        swap = {n: rng.choice(names) for n in names} if rng.random() < 0.4 else dict(zip(names, rng.sample(names, len(names)), strict=True))
        number = defaultdict(lambda: str(rng.randint(1, 3000)))
        out = regex.sub(r"\p{Lu}\p{Ll}+", lambda m: swap.get(m[0], m[0]), item)
        out = regex.sub(r"[0-9][0-9.,]*[0-9]|[0-9]", lambda m: number[m[0]], out)
        w = out.split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            w.insert(rng.randrange(len(w)), rng.choice(["old", "again", "7", "Max"]))
        a = rng.choice([0, 0, 4])
        return " ".join(w[a : rng.choice([len(w), len(w), 14])])

    docs = []
    for _ in range(160):
        parts = [rng.choice([copy(rng.choice(items)), rng.choice(others), " ".join(rng.choice(items).split()[: rng.randint(3, 15)])]) for _ in range(rng.randint(1, 5))]
        docs.append(" . ".join(parts))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r["items"] for r in contaminated(frame, bench, short_items=True).collect()}
    want = {d: own for d, t in enumerate(docs) if (own := [i for i, x in enumerate(items) if held(t, x)])}
    assert got == want and 20 < len(want) < 150
    assert sum(ITEM not in docs[d] for d in want) > 10


def test_pages_of_figures_or_names_are_clean(spark):
    """Runs of placeholders stand for each other one to one, but say nothing; a question with words is still found."""
    figures = " ".join(str(i) for i in range(9000, 9060))
    asked = "Anna buys 7 red apples for 3 euros and sells 5 of them. How many apples are left?"
    again = "Bruno buys 19 red apples for 8 euros and sells 6 of them. How many apples are left?"
    bench = spark.createDataFrame([(1, figures), (2, asked), (3, " ".join(f"Name{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)))], "item_id long, text string")
    docs = [" ".join(map(str, range(9000))), again, " ".join(f"Other{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)), "page " + figures]
    got = {r.doc_id: r["items"] for r in contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()}
    assert got == {1: [2], 3: [1]}


def test_both_items_and_part_of_one(spark):
    part = " ".join(OTHER.split()[:14])
    assert run(spark, [ITEM + ". " + OTHER, part, " ".join(OTHER.split()[:9])]) == {0: [1, 2], 1: [2], 2: []}


def test_matches_brute_force_on_the_small_table(spark):
    import re

    docs = spark.read.parquet(f"{fixtures.SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{fixtures.SMALL}/benchmark.parquet")
    words = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t)]
    windows = lambda t: dict(enumerate(zip(*[words(t)[k:] for k in range(8)], strict=False)))
    items = {r.item_id: windows(r.text) for r in bench.collect()}
    want = {}
    for r in docs.collect():
        own = set(windows(r.text).values())
        held = [i for i, w in items.items() if (n := sum(v in own for v in w.values())) and (n >= 6 or n >= len(w) / 2)]
        if held:
            want[r.doc_id] = sorted(held)
    assert {r.doc_id: r["items"] for r in contaminated(docs, bench).collect()} == want and want
    assert drop_contaminated(docs, bench).count() == docs.count() - len(want)


def test_rows_of_one_id_nulls_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, ITEM, 5), (1, "other text", 6), (1, ITEM, 7), (None, OTHER, 8), (None, "clean", 9)], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, text string")
    assert sorted((r.doc_id is None, r.contaminated) for r in mark_contaminated(frame, bench).collect()) == [(False, False), (False, True), (False, True), (True, False), (True, True)]
    left = drop_contaminated(frame, bench)
    assert left.columns == frame.columns and sorted(r.text for r in left.collect()) == ["clean", "other text"]
    assert mark_contaminated(fixtures.empty(spark), bench).count() == 0
    assert not mark_contaminated(fixtures.docs(spark), bench.limit(0)).where("contaminated").count()


def test_no_python_in_the_plan(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    plan = mark_contaminated(fixtures.docs(spark), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_random_texts_do_not_match(spark):
    rng = random.Random(2)
    docs = [" ".join(fixtures.words(rng, 300)) for _ in range(20)]
    assert not any(run(spark, docs).values())
