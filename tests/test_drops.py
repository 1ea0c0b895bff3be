"""Research drops and salvaged JSON."""

import json

from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.sources import drops

RAW = """---
kind: 'Guide'
card_type: Playbook
sources:
  - skip: me
---
# Question
Why?
## Answer
Because.
## Sources
own words
### One
first
#### Deep
deeper
### Empty
## Notes
left out
"""


def test_research_drop(spark):
    got = drops.research_drop(RAW)
    assert (got["question"], got["answer"], got["card_type"], got["kind"]) == ("Why?", "Because.", "playbook", "guide")
    assert [(b["section"], b["text"]) for b in got["blocks"]] == [("Answer", "Because."), ("Sources", "own words"), ("Sources › One", "first"), ("Sources › Deep", "deeper")]
    assert [b["section"] for b in drops.research_drop("## Answer\nyes")["blocks"]] == ["Answer"]
    frame = spark.createDataFrame([(1, RAW), (2, None), (3, "")], "id long, raw string")
    assert {r.id: len(r.blocks) for r in drops.research_blocks(frame, "id", "raw").collect()} == {1: 4, 2: 0, 3: 0}


def test_salvaged_json(spark):
    whole = [{"src": "a]", "type": 't"{', "dst": "b"}, {"src": "", "type": "t", "dst": "b"}, {"n": {"m": [1]}}]
    text = 'x {"concepts": ' + json.dumps(whole)[:-1] + ', {"src": {"a": 1}, "cut'
    assert [json.loads(o) for o in drops.complete_objects(text)] == whole
    assert drops.complete_objects(None) == drops.complete_objects('{"a": 1}') == [] and drops.complete_objects('[{bad}, {"a":1}] {"b":2}') == ['{"a":1}']
    frame = spark.createDataFrame([(1, text), (2, None), (3, "[]")], "id long, raw string")
    assert [(r.id, r.src, r.type, r.dst) for r in drops.materialised(frame, "id", "raw").collect()] == [(1, "a]", 't"{', "b")]
    assert [r.j for r in spark.createDataFrame([('say {"a": {}} ok',), ("none",)], "t string").select(drops.first_json(F.col("t")).alias("j")).collect()] == ['{"a": {}}', "none"]


def test_features(spark):
    frame = spark.createDataFrame([([("Onset ", "sudden"), ("x", ""), *[(f"f{i}", "v") for i in range(9)]],), (None,)], "f array<struct<feature:string,value:string>>")
    a, b = [r.f for r in frame.select(drops.features(F.col("f")).alias("f")).collect()]
    assert len(a) == 8 and a[0]["feature"] == "onset" and b == []


def test_payload_cleaners(spark):
    rows = [
        ('{"strength":" Strong ","evidence_quality":"odd","statement":" do \\u0001 it ","population":""}', '{"direction":"Increase","study_design":"RCT","certainty":"sure","effect_size":"2x","n":" 40 "}'),
        ('{"strength":"maybe"}', "{}"),
        ("not json", None),
    ]
    frame = spark.createDataFrame(rows, "g string, f string").select(drops.grade(F.col("g")).alias("g"), drops.finding(F.col("f")).alias("f"))
    got = [(r.g and r.g.asDict(), r.f and r.f.asDict()) for r in frame.collect()]
    assert got[0] == ({"strength": "strong", "evidence_quality": None, "statement": "do it", "population": None}, {"direction": "increase", "study_design": "rct", "certainty": None, "effect_size": "2x", "population": None, "n": "40"})
    assert got[1:] == [(None, None), (None, None)]
    text = json.dumps({"required": [{"feature": " Onset ", "value": "sudden"}, {"feature": "", "value": "x"}], "supportive": [], "threshold": "two of three", "differentials": [{"condition": "a", "discriminator": None}, {"condition": " "}], "levels": [{"level": "1", "label": "mild", "features": [{"feature": "T", "value": "v"}]}, {"label": "no name"}]})
    c = spark.createDataFrame([(text,)], "c string").select(drops.criteria(F.col("c")).alias("c")).first().c.asDict(recursive=True)
    assert c == {"required": [{"feature": "onset", "value": "sudden"}], "supportive": None, "exclusion": None, "threshold": "two of three", "gold_standard": None, "differentials": [{"condition": "a", "discriminator": ""}], "levels": [{"level": "1", "label": "mild", "features": [{"feature": "t", "value": "v"}]}]}


def test_card_text(spark):
    row = spark.createDataFrame([("T", "G", ["s1", ""], None, "L")], "t string, g string, steps array<string>, flags array<string>, label string")
    features = "array<struct<value: string>>"
    crit = F.from_json(F.lit('{"required":[{"value":"r"}],"threshold":"h","differentials":[{"condition":"d"}]}'), f"required {features}, supportive {features}, exclusion {features}, threshold string, differentials array<struct<condition: string>>")
    assert row.select(T.card_text(F.col("t"), F.col("g"), [F.col("steps"), F.col("flags")], crit, F.col("label"))).first()[0] == "T G s1 r h d L"
