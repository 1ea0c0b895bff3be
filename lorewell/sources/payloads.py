"""Payloads of conversational and typed cards from JSON: bounded texts and lists, null where a card lacks its shape.

A text that is no JSON gives null, a field of another kind than its card's counts as missing.  Texts are
cleaned and trimmed, empty ones are null; lists of which nothing is left are null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell.sources.drops import FEATURES_SCHEMA, _one_of, _said, features

# Words of a cause's likelihood.
LIKELIHOODS = ("common", "occasional", "rare")


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _kept(a: Column) -> Column:
    return F.get(F.filter(F.array(a), lambda x: F.size(x) > 0), F.lit(0))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _items(a: Column, fields: Callable[[Column], dict[str, Column]], needed: tuple[str, ...], most: int, cut_first: bool = False) -> Column:
    """The items of an array that have all needed fields, up to so many; ``cut_first`` counts the others, too."""
    made = F.transform(F.slice(a, 1, most) if cut_first else a, lambda x: F.struct(*[v.alias(k) for k, v in fields(x).items()]))
    return _kept(F.slice(F.filter(made, lambda x: _all(*[x[k].isNotNull() for k in needed])), 1, most))


def _texts(a: Column, most: int, length: int, cut_first: bool = False) -> Column:
    made = F.transform(F.slice(a, 1, most) if cut_first else a, lambda x: _said(x, length))
    return _kept(F.slice(F.filter(made, lambda x: x.isNotNull()), 1, most))


def _card(fields: dict[str, Column], shaped: Column) -> Column:
    return F.when(shaped, F.struct(*[v.alias(k) for k, v in fields.items()]))


def branch(text: Column) -> Column:
    """A fork: at least two options (when, then), or one and a question to ask next."""
    b = F.from_json(text, "options array<struct<when: string, then: string, because: string>>, situation string, ask_next array<string>, default string")
    options = _items(b["options"], lambda o: {"when": _said(o["when"], 160), "then": _said(o["then"], 240), "because": _said(o["because"], 200)}, ("when", "then"), 8)
    ask = _texts(b["ask_next"], 4, 160, cut_first=True)
    return _card({"options": options, "situation": _said(b["situation"], 240), "ask_next": ask, "default": _said(b["default"], 200)}, (F.size(options) >= 2) | (options.isNotNull() & ask.isNotNull()))


def troubleshooting(text: Column) -> Column:
    """A symptom and its causes, at least one, with how likely they are, a test and a fix."""
    t = F.from_json(text, "causes array<struct<cause: string, likelihood: string, test: string, fix: string>>, symptom string")
    causes = _items(t["causes"], lambda c: {"cause": _said(c["cause"], 200), "likelihood": _one_of(c["likelihood"], LIKELIHOODS), "test": _said(c["test"], 200), "fix": _said(c["fix"], 240)}, ("cause",), 8)
    return _card({"causes": causes, "symptom": _said(t["symptom"], 240)}, causes.isNotNull())


def expectation(text: Column) -> Column:
    """What follows an event: phases with what is normal, at least one, and what alarms."""
    e = F.from_json(text, "timeline array<struct<phase: string, normal: string, alarming: string>>, after string, red_flags array<string>")
    phases = _items(e["timeline"], lambda p: {"phase": _said(p["phase"], 120), "normal": _said(p["normal"], 240), "alarming": _said(p["alarming"], 240)}, ("phase", "normal"), 8)
    return _card({"timeline": phases, "after": _said(e["after"], 200), "red_flags": _texts(e["red_flags"], 6, 200, cut_first=True)}, phases.isNotNull())


def misconception(text: Column) -> Column:
    """A false claim with the truth."""
    m = F.from_json(text, "claim string, truth string, why_believed string")
    claim, truth = _said(m["claim"], 300), _said(m["truth"], 400)
    return _card({"claim": claim, "truth": truth, "why_believed": _said(m["why_believed"], 300)}, claim.isNotNull() & truth.isNotNull())


def enumeration(text: Column) -> Column:
    """Named members of a whole, of the first 24 given; their count is taken from them, complete holds only if it is said."""
    e = F.from_json(text, "relation string, items array<struct<name: string, note: string>>, complete boolean")
    items = lambda x: _items(x, lambda i: {"name": _said(i["name"], 120), "note": _said(i["note"], 200)}, ("name",), 24, cut_first=True)
    fields = _once(e, lambda e: F.struct(_said(e["relation"], 80).alias("relation"), items(e["items"]).alias("items"), F.coalesce(e["complete"], F.lit(False)).alias("complete")))
    return _once(fields, lambda c: _card({"relation": c["relation"], "items": c["items"], "count": F.size(c["items"]), "complete": c["complete"]}, c["relation"].isNotNull() & c["items"].isNotNull()))


_COMMON = f"title string, concept string, evidence string, discriminators {FEATURES_SCHEMA}"


def _typed(text: Column, schema: str, fields: Callable[[Column], dict[str, Column]], needed: tuple[str, ...]) -> Column:
    """A typed card: title, concept (the title where none is given), evidence, discriminators and its own payload."""
    c = F.from_json(text, f"{_COMMON}, {schema}")
    title, own = _said(c["title"], 160), fields(c)
    whole = {"title": title, "concept": F.coalesce(_said(c["concept"], 120), title), "evidence": _said(c["evidence"], 200), "discriminators": features(c["discriminators"]), "payload": F.struct(*[v.alias(k) for k, v in own.items()])}
    return _card(whole, _all(title.isNotNull(), *[own[k].isNotNull() for k in needed]))


def requirements(text: Column) -> Column:
    """What a target must and should have, how to verify it and what follows if it is unmet."""
    fields = lambda c: {"target": _said(c["target"], 200), "must": _texts(c["must"], 8, 200), "should": _texts(c["should"], 8, 200), "verify": _texts(c["verify"], 8, 200), "unmet": _said(c["unmet"], 200)}
    return _typed(text, "target string, must array<string>, should array<string>, verify array<string>, unmet string", fields, ("target", "must"))


def decision(text: Column) -> Column:
    """A decision and its options, up to six, with when they are favoured."""
    option = lambda o: {"option": _said(o["option"], 160), "favors_when": _texts(o["favors_when"], 6, 200), "tradeoffs": _said(o["tradeoffs"], 200)}
    fields = lambda c: {"decision": _said(c["decision"], 200), "options": _items(c["options"], option, ("option",), 6), "default": _said(c["default"], 160)}
    return _typed(text, "decision string, options array<struct<option: string, favors_when: array<string>, tradeoffs: string>>, default string", fields, ("decision", "options"))


def playbook(text: Column) -> Column:
    """A state and the moves that go on from it, up to six."""
    move = lambda m: {"move": _said(m["move"], 200), "when": _said(m["when"], 200), "why": _said(m["why"], 200), "prerequisites": _texts(m["prerequisites"], 5, 200)}
    fields = lambda c: {"state": _said(c["state"], 200), "continuations": _items(c["continuations"], move, ("move",), 6)}
    return _typed(text, "state string, continuations array<struct<move: string, when: string, why: string, prerequisites: array<string>>>", fields, ("state", "continuations"))


def case(text: Column) -> Column:
    """A situation, what was done, its outcome and the lesson."""
    fields = lambda c: {k: _said(c[k], 300) for k in ("situation", "action", "outcome", "lesson")}
    return _typed(text, "situation string, action string, outcome string, lesson string", fields, ("situation", "lesson"))
