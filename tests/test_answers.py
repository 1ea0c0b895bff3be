"""Answers against plain Python, and the fixed tables of understanding and provenance."""

import pytest
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import answers, records
from lorewell.plans.answer_queries import answer_tables
from lorewell.sources import importers

SMALL = "/root/testdata/sf0.001"


def rows(frame):
    return [r.asDict(recursive=True) for r in frame.collect()]


def four(x):
    return int(x * 10000 + 0.5) / 10000


def share(question, text):
    import re

    terms = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 2}
    q = terms(question)
    return min(1.0, len(q & terms(text)) / (len(q) + 1e-6)) if q else 0.0


def plain_answer(asked, hits, nodes, edges, cards, support, understood, k, mode):
    """One question's items, by the definition: pool, walk, pulls, first wins, mode, rank."""
    act, intent, rigor = understood["speech_act"], understood["intent"], understood["rigor"]
    live = {n["id"]: n for n in nodes if n["status"] == "active"}
    own = {}
    for s in support:
        own.setdefault(s["id"], []).append(s)
    factor = lambda kind, i: 0.85 if kind == "node" and own.get(i) and all(s["provenance"] == "research" for s in own[i]) else 1.0
    pool = [("node", h["id"], "concept", h["score"], live[h["id"]]["summary"], live[h["id"]]["regime"]) for h in hits if h["query_id"] == asked["query_id"] and h["id"] in live]
    pool.sort(key=lambda p: (-p[3] * factor("node", p[1]), p[1]))
    latest = lambda es: sorted(es, key=lambda e: (-e["updated_at"].timestamp(), e["id"]))[:20]
    real = [e for e in edges if e["family"] != "meta" and (rigor != "high" or e["regime"] == "empirical")]
    items, starts = list(pool), pool[:2]
    walk = {"why_mech": ("causal", "src", "effect"), "what_if": ("causal", "src", "effect"), "why_diag": ("causal", "dst", "cause"), "taxonomy": ("taxonomic", "src", "is_a"), "who": ("epistemic", "src", "attribution"), "where": ("spatial", "src", "location")}
    for _, node, _, base, _, _ in starts:
        if intent in walk:
            family, end, role = walk[intent]
            # The latest are taken before rigor, as the walk has them of the family alone.
            for e in latest([e for e in real if e["family"] == family and e[end] == node]):
                items.append(("edge", e["id"], role, four(base * (0.6 + 0.4 * share(asked["query"], e["brief"]))) if intent == "why_diag" else four(base * 0.95), e["brief"], e["regime"]))
        if intent == "how":
            for c in sorted((c for c in cards if c["node_id"] == node), key=lambda c: c["card_id"])[:10]:
                items.append(("card", c["card_id"], "management", four(base * (0.6 + 0.4 * share(asked["query"], c["goal"]))), c["goal"], c["regime"]))
    for _, node, _, base, _, _ in starts[:1]:
        out = latest([e for e in real if e["family"] == "causal" and e["src"] == node])
        pulls = {"feasibility": [e for e in out if e["polarity"] == "negative" or e["type"] in answers.WARNING], "counterfactual_omit": [e for e in out if e["type"] in answers.PREVENTING]}
        for e in pulls.get(act, []):
            items.append(("edge", e["id"], {"feasibility": "caution"}.get(act, "risk_if_omitted"), four(base * 0.9), e["brief"], e["regime"]))
        if act == "comparison":
            near = sorted({e["dst"] if e["src"] == node else e["src"] for e in edges if e["family"] == "meta" and node in (e["src"], e["dst"]) and e["src"] != e["dst"]})[:8]
            items += [("node", o, "alternative", four(base * 0.9), live[o]["summary"], live[o]["regime"]) for o in near if o in live]
    first = {}
    for p in items:
        first.setdefault(p[:2], p)
        if first[p[:2]][2] == p[2] and p[3] > first[p[:2]][3]:
            first[p[:2]] = p
    kept = [p for p in first.values() if mode is None or (p[5] or "empirical") in answers.MODES[mode]]
    strength = lambda p: 0.0 if rigor != "high" or p[0] != "node" or p[1] not in own else round(1 - 2.718281828459045 ** (-0.7 / 2), 6)
    kept.sort(key=lambda p: (-strength(p) * factor(*p[:2]), -p[3] * factor(*p[:2]), p[0], p[1]))
    return [(p[0], p[1], p[2], p[3], answers.FRAMES.get(p[5] or "empirical", "") + p[4]) for p in kept[: max(k, 8)]]


@pytest.mark.parametrize("mode", [None, "science"])
def test_answers_equal_plain_python(spark, mode):
    table = lambda n: spark.read.parquet(f"{SMALL}/{n}.parquet")
    n, s = table("nation"), table("supplier")
    tables = answer_tables(s.join(n, s.s_nationkey == n.n_nationkey), table("part"), table("lineitem"))
    got = {}
    for r in answers.answer(*tables, None, 6, mode).collect():
        got.setdefault(r.query_id, []).append(r)
    asked, hits, nodes, edges, cards, support = map(rows, tables)
    understood = {r["query_id"]: r for r in rows(answers.understand(tables[0]))}
    roles, acts = set(), {u["speech_act"] for u in understood.values()}
    for q in asked:
        want = plain_answer(q, hits, nodes, edges, cards, support, understood[q["query_id"]], 6, mode)
        own = sorted((r for r in got[q["query_id"]] if r.kind is not None), key=lambda r: r["rank"])
        assert [(r.kind, r.id, r.role, r.score, r.text) for r in own] == want
        roles |= {r.role for r in own}
        if not want:
            assert [(r.band, r.tier, r.note) for r in got[q["query_id"]]] == [("none", 4, answers.NOTES["none"])]
    assert {"concept", "effect", "management"} <= roles and {"feasibility", "comparison", "counterfactual_omit"} <= acts


def test_an_unfounded_question_has_one_row(spark):
    table = lambda n: spark.read.parquet(f"{SMALL}/{n}.parquet")
    n, s = table("nation"), table("supplier")
    asked, hits, *rest = answer_tables(s.join(n, s.s_nationkey == n.n_nationkey), table("part"), table("lineitem"))
    out = answers.answer(asked, hits.limit(0), *rest, None)
    assert {(r.band, r.tier, r.kind) for r in out.collect()} == {("none", 4, None)} and out.count() == asked.count()
    assert answers.gap_questions(out, asked).count() == asked.select(F.lower("query")).distinct().count()


def test_speech_acts_of_known_utterances(spark):
    want = {
        "Which one would you prefer, tea?": ("comparison", 0.8),
        "Coffee vs tea": ("comparison", 0.8),
        "What if we skipped the rinse": ("counterfactual_omit", 0.85),
        "If they had not done it": ("ambiguous", 0.3),
        "if i didn't water it": ("counterfactual_omit", 0.85),
        "What if it failed to start": ("counterfactual_omit", 0.85),
        "Am I allowed to weld here": ("feasibility", 0.85),
        "Is it ruled out": ("feasibility", 0.85),
        "What happens if it rains": ("hypothetical", 0.8),
        "what about when it freezes": ("hypothetical", 0.8),
        "What's driving the noise": ("diagnostic", 0.8),
        "aetiology of the fault": ("diagnostic", 0.8),
        "I'm in the middle of painting": ("in_progress", 0.75),
        "The pump showed a leak": ("observation", 0.7),
        "She underwent training": ("observation", 0.7),
        "Name the parts?": ("factual", 0.6),
        "tell me who built it": ("factual", 0.6),
        "parts list": ("ambiguous", 0.3),
        "": ("ambiguous", 0.0),
    }
    frame = spark.createDataFrame([(q,) for q in want], "q string").select("q", T.speech_act(F.col("q")).alias("s")).select("q", "s.*")
    assert {r.q: (r.act, r.confidence) for r in frame.collect()} == want


def test_licences_and_holders(spark):
    want = {
        "© 2019 Big Corp. All rights reserved": ("all-rights-reserved", "Big Corp"),
        "Copyright (c) 2001-2003 by Ann Smith, licensed under GPL": (None, "Ann Smith"),
        "x" * 30000 + "SPDX-License-Identifier: BSD-3-Clause": ("BSD-3-Clause", None),
        "creativecommons.org/publicdomain/zero/1.0": ("CC0-1.0", None),
        "https://creativecommons.org/licenses/by-sa/4.0/": ("CC-BY-SA-4.0", None),
        "This is in the public domain.": ("public-domain", None),
        "nothing here": (None, None),
    }
    frame = spark.createDataFrame([(q,) for q in want], "q string").select("q", T.detect_licence(F.col("q")).alias("l")).select("q", "l.*")
    assert {r.q: (r.licence, r.holder) for r in frame.collect()} == want


def test_fixed_tables_hold_their_values():
    assert len(importers.RELATIONS) == 37 and importers.RELATIONS["NotCapableOf"] == ("functional", "capable_of", "negative") and "HasContext" in importers.LEXICAL
    assert records.TYPE_TRUST["causenet"] == 0.4 and records.TYPE_REGIME["novel"] == "fictional" and set(records.TYPE_TRUST) == set(records.TYPE_REGIME)
    assert T.LICENCES["CC-BY-ND-4.0"] == (True, False, True, True, False) and len(T.LICENCES) == 16 and T.LICENCE_NAMES["gplv3"] == "GPL-3.0-only"


def test_readers_scan_files(spark, tmp_path):
    (tmp_path / "events.csv").write_text('event,xWant,xReact\n"PersonX says ""hi"", twice","[""to win"", ""To Win""]","[""glad""]"\n"PersonX\nwaits","[""none"", ""none""]","[]"\n')
    table = importers.read_csv(spark, str(tmp_path / "events.csv"))
    assert table.count() == 2 and [(r.event, r.value) for r in importers.events(table, 2).collect()] == [('PersonX says "hi", twice', "to win")]
    good = '{"causal_relation":{"cause":{"concept":"a_b"},"effect":{"concept":"c"}},"sources":[{"type":"web","payload":{"sentence":"s"}}]}'
    (tmp_path / "causes.jsonl").write_text(f"{good}\n{good[:-9]}\n\n{{}}\n{good}\n")
    records_, counts = importers.read_records(spark, str(tmp_path / "causes.jsonl"))
    assert [(r.cause, r.effect) for r in importers.causes(records_).collect()] == [("a b", "c")] and tuple(counts.first()) == (4, 2)
    (tmp_path / "a.tsv").write_text('u1\t/r/IsA\t/c/en/cat/n\t/c/en/pet\t{"weight": 2.0}\nu2\t/r/HasContext\t/c/en/cat\t/c/en/zoo\t{"weight": 2.0}\nu3\t/r/Odd\t/c/en/a\t/c/en/b\t{}\nu4\t/r/IsA\t/c/fr/chat\t/c/en/pet\t{}\n')
    found = {r.uri: (r.family, r.type, r.src, r.outcome) for r in importers.assertions(importers.read_tsv(spark, str(tmp_path / "a.tsv"))).collect()}
    assert found == {"u1": ("taxonomic", "is_a", "cat", "kept"), "u2": ("lexical", "has_context", "cat", "lexical"), "u3": (None, None, "a", "unknown"), "u4": ("taxonomic", "is_a", "chat", "language")}
    both = importers.assertions(importers.read_tsv(spark, str(tmp_path / "a.tsv")), exclude=["HasContext"], lexical=True)
    assert both.where("uri = 'u2'").first().outcome == "excluded"


def test_edges_of_many_ends_are_not_taken_for_each_other(spark, tmp_path):
    """Removal and closure where the ends (1, 1000001) and (2, 1) make one number."""
    from lorewell.plans import catalog

    from .oracle import compare

    lines = [(1, 1, 1000001), (2, 2, 1), (2, 1, 1000001), (3, 2, 1), (3, 5, 6), (4, 2, 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").coalesce(1).write.parquet(str(tmp_path / "l"))
    orders = [(i, i, "O", "1-URGENT") for i in range(1, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").coalesce(1).write.parquet(str(tmp_path / "o"))
    for short, name in (("l", "lineitem"), ("o", "orders")):
        next((tmp_path / short).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    for name in ("removed_documents", "bundle_closure"):
        compare(spark, str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name])


def test_zones_of_pending_chunks_are_their_headings(spark, tmp_path):
    """Texts that look like references or a table of contents under a plain heading are no references."""
    from lorewell.plans import catalog

    from .oracle import compare

    cited = "\n".join(f"Smith, J., and Jones, K., Some Title, Press, {1990 + i}." for i in range(8))
    toc = "\n".join(f"Chapter {i} .......... {i}" for i in range(1, 12))
    rows = [(i, (cited, toc, "A plain text.", None)[i % 4 if i % 3 else 2], "en", "s") for i in range(1, 60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    compare(spark, str(tmp_path), catalog.queries()["pending_chunks"], catalog.oracle_sql()["pending_chunks"])


def test_ids_of_one_set_of_features_are_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    from lorewell.operators import ask

    has = spark.range(4000).select("id", F.lit("f").alias("feature"), F.lit(1).alias("value")).unionAll(spark.createDataFrame([(5000, "f", 2), (5001, "f", None), (5002, "g", 1)], "id long, feature string, value int"))
    out = ask.feature_overlap(has.where("id % 100 = 0 or id > 4000").withColumnRenamed("id", "query_id"), has)
    rows = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in rows) == 42 * 4002 + 1 and max(r["count"] for r in rows) < 21 * 4002
    got = {(r.query_id, r.id): r.overlap for r in out.where("query_id in (0, 5000, 5001) and id in (7, 5000, 5001)").collect()}
    assert got == {(0, 7): 0.999999, (0, 5000): 0.0, (5000, 7): 0.0, (5000, 5000): 0.999999} | {k: got[k] for k in got if 5001 in k}
