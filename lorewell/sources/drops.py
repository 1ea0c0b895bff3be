"""Answers dropped by other tools: Markdown with front matter, and JSON that a model wrote."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from lorewell.functions import text as T

_HEADING = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*")
_SCALAR = re.compile(r"([A-Za-z0-9_]+):[ \t]*(.+?)[ \t]*")
#: Marks of JSON that matter to nesting; a string that does not end runs to the end.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\]]', re.S)


def front_matter(raw: str | None) -> tuple[dict[str, str], str]:
    """(scalars, body): ``key: value`` lines between a first and a next line of three dashes; nested lines are left out."""
    body = raw or ""
    lines = body.lstrip("﻿").splitlines(keepends=True)
    marks = [i for i, line in enumerate(lines) if line.rstrip() == "---" and line.endswith("\n")]
    if len(marks) < 2 or marks[0] or marks[1] < 2:
        return {}, body
    found = {}
    for line in lines[1 : marks[1]]:
        if m := _SCALAR.fullmatch(line.rstrip("\r\n")):
            quoted = re.fullmatch(r"(['\"])(.*)\1", m[2])
            found[m[1].lower()] = quoted[2] if quoted else m[2]
    return found, "".join(lines[marks[1] + 1 :])


def research_drop(raw: str | None) -> dict:
    """question, answer, card_type, kind, trust and blocks (section, text) of a solved question.

    The sections below a heading that begins with "source" are the blocks.  Without any, the
    answer is the one block; a drop that names a card type puts its answer first.
    """
    meta, body = front_matter(raw)
    said = {"question": "", "answer": ""}
    blocks: list[tuple[str, str]] = []
    under: tuple[int, str] | None = None  # the sources heading we are below
    place, held = None, []

    def close() -> None:
        text = "\n".join(held).strip()
        held.clear()
        if place in said:
            said[place] = text
        elif place and text:
            blocks.append((place[1], text))

    for line in body.splitlines():
        m = _HEADING.fullmatch(line)
        if not m:
            held.append(line)
            continue
        close()
        level, head = len(m[1]), m[2].strip()
        low = head.lower()
        if under and level > under[0]:
            place = ("block", f"{under[1]} › {head}")
            continue
        under = None
        if level == 1 and low.startswith("question"):
            place = "question"
        elif low.startswith("answer"):
            place = "answer"
        elif low.startswith("source"):
            under, place = (level, head), ("block", head)
        else:
            place = None
    close()
    card = meta.get("card_type", "").strip().lower() or None
    if said["answer"] and (card or not blocks):
        blocks.insert(0, ("Answer", said["answer"]))
    return {"question": said["question"] or None, "answer": said["answer"] or None, "card_type": card, "kind": meta.get("kind", "").lower() or None, "trust": meta.get("trust"), "blocks": [{"section": s, "text": t} for s, t in blocks]}


_DROP = "question string, answer string, card_type string, kind string, trust string, blocks array<struct<section string, text string>>"


def research_blocks(files: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, question, answer, card_type, kind, trust, blocks) of Markdown drops."""

    def run(batches):
        for rows in batches:
            found = [research_drop(x) for x in rows[raw]]
            yield pd.DataFrame({key: rows[key], **{c: pd.Series([f[c] for f in found], dtype=object) for c in ("question", "answer", "card_type", "kind", "trust", "blocks")}})

    return files.select(key, raw).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, {_DROP}")


def first_json(text: Column) -> Column:
    """From the first opening brace to the last closing one; the text itself without them."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(text)


def complete_objects(text: str | None) -> list[str]:
    """The whole JSON objects of the first array of a text, canonical; a cut one at the end and broken ones are left out."""
    at = (text or "").find("[")
    out, depth, began = [], 0, 0
    for m in _MARKS.finditer(text, at) if at >= 0 else ():
        mark = m[0]
        if mark == "{":
            began = m.start() if depth == 0 else began
            depth += 1
        elif mark == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    out.append(json.dumps(json.loads(text[began : m.end()]), ensure_ascii=False, separators=(",", ":"), sort_keys=True))
                except ValueError:
                    continue
        elif mark == "]" and depth == 0:
            break
    return out


@F.pandas_udf(types.ArrayType(types.StringType()))
def salvaged_objects(texts: pd.Series) -> pd.Series:
    return texts.map(complete_objects)


def features(items: Column, most: int = 8) -> Column:
    """An array of (feature, value) cleaned: lower-cased names, both bounded and not empty, the first eight."""
    each = F.transform(F.coalesce(items, F.array().cast("array<struct<feature:string,value:string>>")), lambda x: F.struct(F.lower(F.trim(T.clean(x["feature"], 40))).alias("feature"), F.trim(T.clean(x["value"], 60)).alias("value")))
    return F.slice(F.filter(each, lambda x: (x["feature"] != "") & (x["value"] != "")), 1, most)


# The words that graded and empirical claims may use.
STRENGTHS, QUALITIES = ("strong", "conditional", "weak"), ("high", "moderate", "low", "very_low")
DIRECTIONS, CERTAINTIES = ("increase", "decrease", "no_effect", "mixed"), ("high", "moderate", "low")
DESIGNS = ("meta_analysis", "rct", "cohort", "case_control", "case_series", "expert_opinion", "guideline")
#: Differentials and levels of a criteria card, at most.
FEW = 12
GRADE = "strength string, evidence_quality string, statement string, population string"
FINDING = "direction string, study_design string, certainty string, effect_size string, population string, n string"
FEATURES_SCHEMA = "array<struct<feature: string, value: string>>"
CRITERIA = f"required {FEATURES_SCHEMA}, supportive {FEATURES_SCHEMA}, exclusion {FEATURES_SCHEMA}, threshold string, gold_standard string, differentials array<struct<condition: string, discriminator: string>>, levels array<struct<level: string, label: string, features: {FEATURES_SCHEMA}>>"


def _one_of(value: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.btrim(value))
    return F.when(low.isin(list(words)), low)


def _said(value: Column, most: int) -> Column:
    """A cleaned text of a bounded length, or null where nothing is left."""
    # By a filter, not by a condition on the text, which would clean it twice.
    return F.get(F.filter(F.array(F.btrim(T.clean(value, most))), lambda s: s != ""), F.lit(0))


def _filled(fields: dict[str, Column]) -> Column:
    """A struct of the fields, or null if all are."""
    whole = F.struct(*[v.alias(k) for k, v in fields.items()])
    return F.when(F.coalesce(*[v.cast("string") for v in fields.values()]).isNotNull(), whole)


def grade(text: Column) -> Column:
    """A graded recommendation from JSON: strength and quality of known words, statement and population; null if nothing is left."""
    g = F.from_json(text, GRADE)
    return _filled({"strength": _one_of(g["strength"], STRENGTHS), "evidence_quality": _one_of(g["evidence_quality"], QUALITIES), "statement": _said(g["statement"], 300), "population": _said(g["population"], 200)})


def finding(text: Column) -> Column:
    """An empirical claim from JSON: direction, design and certainty of known words, effect, population and n; null if nothing is left."""
    f = F.from_json(text, FINDING)
    words = {"direction": _one_of(f["direction"], DIRECTIONS), "study_design": _one_of(f["study_design"], DESIGNS), "certainty": _one_of(f["certainty"], CERTAINTIES)}
    return _filled(words | {"effect_size": _said(f["effect_size"], 80), "population": _said(f["population"], 200), "n": _said(f["n"], 40)})


def criteria(text: Column) -> Column:
    """A criteria payload from JSON: features that must, may and must not hold, threshold, standard, differentials and ordered levels.

    Lists are null where nothing of them is left; a differential needs a condition, a level its name.
    """
    c = F.from_json(text, CRITERIA)
    some = lambda a: F.when(F.size(a) > 0, a)
    lists = {k: some(features(c[k])) for k in ("required", "supportive", "exclusion")}
    near = F.transform(F.slice(c["differentials"], 1, FEW), lambda d: F.struct(_said(d["condition"], 80).alias("condition"), F.coalesce(_said(d["discriminator"], 200), F.lit("")).alias("discriminator")))
    steps = F.transform(F.slice(c["levels"], 1, FEW), lambda x: F.struct(_said(x["level"], 40).alias("level"), _said(x["label"], 200).alias("label"), some(features(x["features"])).alias("features")))
    rest = {"threshold": _said(c["threshold"], 200), "gold_standard": _said(c["gold_standard"], 200), "differentials": some(F.filter(near, lambda d: d["condition"].isNotNull())), "levels": some(F.filter(steps, lambda x: x["level"].isNotNull()))}
    return F.struct(*[v.alias(k) for k, v in (lists | rest).items()])


def materialised(extractions: DataFrame, key: str, text: str, most: int = 20) -> DataFrame:
    """(key, seq, src, type, dst, label_hash) claims of extraction JSON, also of cut ones, at most 20 a document as the model states.

    Each salvaged object is one relation {src, type, dst}; those without all three are left out
    before the cap.
    """
    rows = extractions.select(key, F.posexplode(salvaged_objects(F.col(text))).alias("seq", "o"))
    parsed = rows.select(key, "seq", F.from_json("o", "src string, type string, dst string").alias("r")).select(key, "seq", *[F.trim(T.clean(F.col(f"r.{c}"))).alias(c) for c in ("src", "type", "dst")])
    whole = parsed.where("src <> '' and type <> '' and dst <> ''")
    first = whole.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where(F.col("_n") <= most).drop("_n")
    return first.withColumn("label_hash", T.short_hash("src", "type", "dst"))
