"""Payloads of cards: what is kept, what is cut, and shapes without which there is no card."""

import json

import pytest
from pyspark.sql import functions as F

from lorewell.sources import payloads


def read(spark, cleaner, *objects):
    frame = spark.createDataFrame([(i, o if o is None or isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)], "i int, j string").repartition(1)
    return [r.c and r.c.asDict(recursive=True) for r in frame.select("i", cleaner(F.col("j")).alias("c")).orderBy("i").collect()]


def test_branch(spark):
    one = [{"when": " dry \u0001", "then": "drops", "because": ""}, {"when": "x"}]
    two, asked, bare = read(spark, payloads.branch, {"options": one * 10, "situation": " s "}, {"options": one, "ask_next": ["", "which eye?", *"abcd"]}, {"options": one})
    assert len(two["options"]) == 8 and two["options"][0] == {"when": "dry", "then": "drops", "because": None} and two["situation"] == "s"
    assert asked["ask_next"] == ["which eye?", "a", "b"] and len(asked["options"]) == 1 and bare is None


def test_troubleshooting_expectation_misconception(spark):
    causes = [{"cause": "c", "likelihood": " Rare ", "fix": "f"}, {"cause": " "}, {"cause": "d", "likelihood": "never"}]
    t, none = read(spark, payloads.troubleshooting, {"causes": causes, "symptom": "s"}, {"symptom": "s"})
    assert [(c["cause"], c["likelihood"], c["fix"]) for c in t["causes"]] == [("c", "rare", "f"), ("d", None, None)] and t["symptom"] == "s" and none is None
    e, none = read(spark, payloads.expectation, {"timeline": [{"phase": "p", "normal": "n" * 300}, {"phase": "q"}], "red_flags": list("abcdefgh")}, {"timeline": []})
    assert len(e["timeline"]) == 1 and e["timeline"][0]["normal"] == "n" * 240 + "…" and e["red_flags"] == list("abcdef") and none is None
    m, none = read(spark, payloads.misconception, {"claim": "c", "truth": "t", "why_believed": " "}, {"claim": "c", "truth": ""})
    assert m == {"claim": "c", "truth": "t", "why_believed": None} and none is None


def test_enumeration(spark):
    items = [{"name": ""}, {"name": "a", "note": "x"}, *[{"name": f"n{i}"} for i in range(30)]]
    e, none, other = read(spark, payloads.enumeration, {"relation": "r", "items": items, "count": 99}, {"items": items}, {"relation": "r", "items": items[:2], "complete": True})
    assert e["count"] == len(e["items"]) == 23 and e["items"][0] == {"name": "a", "note": "x"} and not e["complete"]
    assert none is None and other["complete"] and other["count"] == 1


def test_typed(spark):
    common = {"title": "T", "discriminators": [{"feature": "Onset", "value": "sudden"}]}
    r, bare = read(spark, payloads.requirements, common | {"target": "t", "must": ["", "m", *"abcdefgh"]}, {"target": "t", "must": ["m"]})
    assert r["concept"] == "T" and r["payload"]["must"] == ["m", *"abcdefg"] and r["payload"]["should"] is None and r["discriminators"] == [{"feature": "onset", "value": "sudden"}] and bare is None
    d, bare = read(spark, payloads.decision, common | {"decision": "d", "options": [{"option": " "}, *[{"option": f"o{i}", "favors_when": ["w"]} for i in range(9)]]}, common | {"decision": "d"})
    assert [o["option"] for o in d["payload"]["options"]] == [f"o{i}" for i in range(6)] and d["payload"]["options"][0]["favors_when"] == ["w"] and bare is None
    p, bare = read(spark, payloads.playbook, common | {"concept": "c", "state": "s", "continuations": [{"move": "m", "prerequisites": list("abcdefg")}]}, common | {"state": "s", "continuations": [{"when": "w"}]})
    assert p["concept"] == "c" and p["payload"]["continuations"][0]["prerequisites"] == list("abcde") and bare is None
    c, bare = read(spark, payloads.case, common | {"situation": "s", "lesson": "l"}, common | {"situation": "s", "outcome": "o"})
    assert c["payload"] == {"situation": "s", "action": None, "outcome": None, "lesson": "l"} and bare is None


@pytest.mark.parametrize("name", ["branch", "troubleshooting", "expectation", "misconception", "enumeration", "requirements", "decision", "playbook", "case"])
def test_what_is_no_card(spark, name):
    assert read(spark, getattr(payloads, name), None, "", "no json", "[]", "{}", {"options": "x", "causes": 3, "items": "y", "title": ["z"]}) == [None] * 6


def test_enumerations_are_parsed_once(spark):
    """A card's filter and its fields share one parse."""
    from lorewell.plans import catalog

    plan = catalog.queries()["enumerated_parts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
