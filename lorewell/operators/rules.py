"""Conflict rules: expressions compiled to columns, scopes closed over ancestors, findings.

A missing field makes a comparison null, and SQL's AND, OR and NOT carry nulls as the rules'
three values do.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.session import saved

MAX_DEPTH = 4
#: Severities from light to heavy, and what is recommended where a rule fires.
SEVERITY = {"advisory": 1, "caution": 2, "severe": 3, "prohibitive": 4}
RECOMMENDED = {"prohibitive": "block", "severe": "warn_strong", "caution": "warn", "advisory": "note"}
_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq}


def validate(expr: dict, depth: int = 1) -> None:
    """Raises ValueError for an expression outside the grammar or deeper than MAX_DEPTH."""
    if not isinstance(expr, dict) or depth > MAX_DEPTH:
        raise ValueError(f"not an expression, or too deep: {expr!r}")
    op = expr.get("op")
    if op in ("presence", "absence"):
        good = isinstance(expr.get("pred"), str)
    elif op == "compare":
        operand = expr.get("operand")
        good = isinstance(expr.get("field"), str) and expr.get("cmp") in _COMPARE and isinstance(operand, dict) and len(operand) == 1 and set(operand) <= {"lit", "field"}
    elif op == "not":
        validate(expr.get("arg"), depth + 1)
        good = True
    elif op in ("all_of", "any_of"):
        good = bool(expr.get("args"))
        for arg in expr.get("args") or []:
            validate(arg, depth + 1)
    else:
        good = False
    if not good:
        raise ValueError(f"bad expression: {expr!r}")


def compile_expression(expr: dict, predicates: Column, fields: Column) -> Column:
    """A boolean column over an array of predicates and a map of fields: true, false or null."""
    op = expr["op"]
    if op == "presence":
        return F.array_contains(predicates, expr["pred"])
    if op == "absence":
        return ~F.array_contains(predicates, expr["pred"])
    if op == "compare":
        value = lambda name: F.try_element_at(fields, F.lit(name)).cast("double")
        operand = expr["operand"]
        right = F.lit(float(operand["lit"])) if "lit" in operand else value(operand["field"])
        return _COMPARE[expr["cmp"]](value(expr["field"]), right)
    if op == "not":
        return ~compile_expression(expr["arg"], predicates, fields)
    parts = [compile_expression(a, predicates, fields) for a in expr["args"]]
    return reduce(operator.and_ if op == "all_of" else operator.or_, parts)


def ancestors(is_a: DataFrame, start: DataFrame) -> DataFrame:
    """(node, ancestor) of start (node), itself included, however far up; safe on cycles.

    Each step's new rows are written to the shared folder; steps go on until there are none.
    Both joins are by shuffles: a step's rows, small as they may be, would be broadcast through the driver each time.
    """
    out = saved(start.select("node", F.col("node").alias("ancestor")).distinct())
    step, up = out, is_a.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"))
    while True:
        new = saved(step.join(up.hint("merge"), "ancestor").select("node", F.col("next").alias("ancestor")).distinct().join(out.hint("merge"), ["node", "ancestor"], "left_anti"))
        if not new.limit(1).count():
            return out
        out, step = out.unionAll(new), new


def scope(actions: DataFrame, is_a: DataFrame, uses: DataFrame, member_of: DataFrame) -> DataFrame:
    """(action, node): an action, what it uses, the groups of both, and all their ancestors."""
    first = actions.select("action", F.col("action").alias("node")).distinct()
    used = first.join(uses.select(F.col("action").alias("node"), "resource"), "node").select("action", F.col("resource").alias("node"))
    seeds = first.union(used).distinct()
    above = lambda rows: rows.join(ancestors(is_a, rows.select("node").distinct()), "node").select("action", F.col("ancestor").alias("node")).distinct()
    closed = above(seeds)
    groups = closed.join(member_of.select(F.col("member").alias("node"), "grouper"), "node").select("action", F.col("grouper").alias("node")).distinct()
    return closed.union(above(groups)).distinct()


def check(states: DataFrame, scopes: DataFrame, rules: list[dict], overrides: DataFrame | None = None) -> DataFrame:
    """Findings (state_id, action, edge_id, disposition, severity, recommended, rank) of states.

    The rules are compiled into the plan, so that their number is the caller's bound.

    states: (state_id, action, predicates, fields).  rules: edge_id, subject, severity, status and
    expr.  A false rule is silent, an unknown or proposed one is for a human, an override on a node
    in scope suppresses; findings that fire come first, then by severity and id.
    """
    for r in rules:
        validate(r["expr"])
    spark = states.sparkSession
    table = spark.createDataFrame([(r["edge_id"], r["subject"], r["severity"], r["status"], SEVERITY[r["severity"]], RECOMMENDED[r["severity"]]) for r in rules], "edge_id string, subject string, severity string, status string, weight int, recommended string")
    result = reduce(lambda out, r: out.when(F.col("edge_id") == r["edge_id"], compile_expression(r["expr"], F.col("predicates"), F.col("fields"))), rules[1:], F.when(F.col("edge_id") == rules[0]["edge_id"], compile_expression(rules[0]["expr"], F.col("predicates"), F.col("fields"))))
    candidates = states.join(scopes.withColumnRenamed("node", "subject"), "action").join(F.broadcast(table), "subject").where("status <> 'deprecated'")
    if overrides is not None:
        silenced = candidates.select("state_id", "action", "edge_id").join(overrides, "edge_id").join(scopes.withColumnRenamed("node", "on_node"), ["action", "on_node"]).select("state_id", "action", "edge_id").distinct()
        candidates = candidates.join(silenced, ["state_id", "action", "edge_id"], "left_anti")
    rows = candidates.withColumn("result", result).where("result is null or result")
    fires = F.col("result").isNotNull() & (F.col("status") != "proposed")
    rows = rows.withColumn("disposition", F.when(fires, "fire").otherwise("flag_for_human")).withColumn("recommended", F.when(fires, F.col("recommended")).otherwise("human_review"))
    w = Window.partitionBy("state_id").orderBy(F.when(fires, 0).otherwise(1), F.desc("weight"), "edge_id", "action")
    return rows.withColumn("rank", F.row_number().over(w)).select("state_id", "action", "edge_id", "disposition", "severity", "recommended", "rank")


def clearance(states: DataFrame, findings: DataFrame) -> DataFrame:
    """(state_id, clearance): conflicts_found, review_required or no_known_conflicts."""
    worst = findings.groupBy("state_id").agg(F.max((F.col("disposition") == "fire").cast("int")).alias("f"))
    rows = states.select("state_id").distinct().join(worst, "state_id", "left")
    return rows.select("state_id", F.when(F.col("f") == 1, "conflicts_found").when(F.col("f") == 0, "review_required").otherwise("no_known_conflicts").alias("clearance"))
