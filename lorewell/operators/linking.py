"""Linking of concepts: a batch of new ones to nodes in their order, and candidates for links between nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.operators.blocks import ANY, near_in_blocks
from lorewell.operators.graph import NEAR_SIM, SAME_SIM, key_hash, stems
from lorewell.operators.search import top_k
from lorewell.session import written


def _terms(frame: DataFrame) -> DataFrame:
    """Adds own, the stems of the label, and terms, those of the aliases too."""
    own = stems(F.coalesce("label", F.lit("")))
    aliases = F.flatten(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: stems(F.coalesce(a, F.lit("")))))
    return frame.withColumn("own", own).withColumn("terms", F.array_distinct(F.concat("own", aliases)))


def _asked(todo: DataFrame, low: float) -> DataFrame:
    """What may still be a better node than the best so far: more similar, or as similar and earlier."""
    return todo.select(F.col("ord").alias("id"), "vec", F.lit(1).alias("keep"), F.coalesce("sim", F.lit(low)).alias("floor"), F.coalesce(F.col("best") - 1, F.lit(ANY)).alias("tie"))


def link_batch(nodes: DataFrame, batch: DataFrame, low: float = NEAR_SIM, high: float = SAME_SIM) -> DataFrame:
    """(ord, node, action, best, similarity, specific): the node of each concept of a batch, as if they came one by one.

    Nodes (ord, id, label, aliases, vec) are there already; concepts (ord, label, kind, aliases, vec) have larger
    ords, unique in both, and unit vectors (null: never similar).  A concept meets the most similar node that
    is there when it comes, an earlier concept's among them, the earlier of equal ones.  From ``high``
    on with a stem in common it is the ``same`` and adds its label and aliases to the node; otherwise, from ``low`` on, a new
    node that is ``distinct_isa`` (the stems of one label hold all of the other's: ``specific`` says which, ``concept``
    or ``best``) or ``distinct_adjudicate``; else ``new``.  A new node whose label and kind an earlier one has is that node.

    Rounds decide what no undecided earlier concept can change: none is nearer than the best node, none that may
    join the node shares a stem, none has the same label and kind.  The first undecided concept is always
    decided; copies wait for their first one alone, so that rounds are the longest chain and not the rows.
    Vectors meet in bounded blocks; names meet by joins on keys of which minima are taken first.
    """
    spark = batch.sparkSession
    nodes = _terms(nodes)
    names = nodes.select("ord", "id", "own")
    known = nodes.select(F.col("ord").alias("node"), F.explode("terms").alias("term"), F.col("ord").alias("first"))
    fresh = nodes.select(F.col("ord").alias("id"), "vec")
    todo, drop_todo = written(_terms(batch).select("ord", key_hash(F.lit("node"), F.col("label"), F.col("kind")).alias("key"), "own", "terms", "vec", F.lit(None).cast("double").alias("sim"), F.lit(None).cast("long").alias("best")))
    done = spark.createDataFrame([], "ord long, node string, action string, best string, similarity double, specific string")
    while not todo.isEmpty():
        near = near_in_blocks(_asked(todo, low), fresh, earlier=True).groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m"))
        better = near.select(F.col("query_id").alias("ord"), (-F.col("m.s")).alias("sim_"), F.col("m.id").alias("best_"))
        moved, drop_moved = written(todo.join(better, "ord", "left").select("ord", "key", "own", "terms", "vec", F.coalesce("sim_", "sim").alias("sim"), F.coalesce("best_", "best").alias("best")))
        drop_todo()
        todo, drop_todo = moved, drop_moved
        behind = near_in_blocks(_asked(todo, low), todo.select(F.col("ord").alias("id"), "vec"), earlier=True).select(F.col("query_id").alias("ord")).distinct()
        claims = todo.where(F.col("sim") >= high).select("ord", "best", F.explode("terms").alias("term"))
        joined = claims.join(known.select(F.col("node").alias("best"), "term", "first"), ["best", "term"]).where("first < ord").select("ord").distinct()
        heads = claims.groupBy("best", "term").agg(F.min("ord").alias("head"))
        waiting = claims.join(heads, ["best", "term"]).where("head < ord").select("ord").distinct()
        keys = todo.groupBy("key").agg(F.min("ord").alias("head"))
        marked = todo.join(behind.withColumn("behind", F.lit(True)), "ord", "left").join(joined.withColumn("joined", F.lit(True)), "ord", "left").join(waiting.withColumn("waiting", F.lit(True)), "ord", "left")
        marked = marked.join(keys, "key").join(names.select(F.col("id").alias("key"), F.lit(True).alias("there")).distinct(), "key", "left")
        marked = marked.join(names.select(F.col("ord").alias("best"), F.col("id").alias("best_id"), F.col("own").alias("best_own")), "best", "left")
        alone = F.col("waiting").isNull() & (F.col("there").isNotNull() | (F.col("head") == F.col("ord")))
        fate = F.when(F.col("behind").isNotNull(), "wait").when(F.col("joined").isNotNull(), "same").when(alone, "apart").otherwise("wait")
        shared = F.size(F.array_intersect("own", "best_own"))
        more = (F.size("best_own") > 0) & (shared == F.size("best_own")) & (F.size("own") > shared)
        less = (F.size("own") > 0) & (shared == F.size("own")) & (F.size("best_own") > shared)
        specific = F.when((F.col("fate") == "apart") & F.col("sim").isNotNull(), F.when(more, "concept").when(less, "best"))
        action = F.when(F.col("fate") == "same", "same").when(F.col("sim").isNull(), "new").when(F.col("specific").isNotNull(), "distinct_isa").otherwise("distinct_adjudicate")
        step, drop_step = written(marked.withColumn("fate", fate).withColumn("specific", specific).withColumn("action", action))
        drop_todo()
        settled, _ = written(step.where("fate <> 'wait'").select("ord", F.when(F.col("fate") == "same", F.col("best_id")).otherwise(F.col("key")).alias("node"), "action", F.col("best_id").alias("best"), F.col("sim").alias("similarity"), "specific"))
        done = done.union(settled)
        born = written(step.where("fate = 'apart' and there is null").select("ord", F.col("key").alias("id"), "own", "terms", "vec"))[0]
        names = names.union(born.select("ord", "id", "own"))
        told = step.where("fate = 'same'").select(F.col("best").alias("node"), F.explode("terms").alias("term"), F.col("ord").alias("first"))
        known = written(known.union(told).union(born.select(F.col("ord").alias("node"), F.explode("terms").alias("term"), F.col("ord").alias("first"))).groupBy("node", "term").agg(F.min("first").alias("first")))[0]
        fresh = born.select(F.col("ord").alias("id"), "vec")
        todo, drop_todo = written(step.where("fate = 'wait'").select("ord", "key", "own", "terms", "vec", "sim", "best"))
        drop_step()
    drop_todo()
    return done


def _pair(a: str = "a", b: str = "b") -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linker_candidates(nodes: DataFrame, anchors: DataFrame, judged: DataFrame | None = None, k: int = 8, floor: float = 0.5) -> DataFrame:
    """(a, b, similarity), a < b: each pair of an anchor (id) and one of its k nearest nodes, once, without pairs judged before.

    Nodes (id, vec, prior): prior ones are no anchors and no neighbours, and are left out before the k are
    taken; pairs judged before (a, b, in either order) are left out after it, so that no farther node takes their place.
    """
    real = nodes.where(~F.coalesce("prior", F.lit(False)))
    asked = real.join(anchors.select("id"), "id", "left_semi")
    rows = near_in_blocks(asked.select("id", "vec", F.lit(k).alias("keep"), F.lit(floor).alias("floor"), F.lit(ANY).alias("tie")), real)
    near = top_k(rows, k).select(*_pair("query_id", "id"), F.col("score").alias("similarity")).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return near if judged is None else near.join(judged.select(*_pair()).distinct(), ["a", "b"], "left_anti")


def link_pass(nodes: DataFrame, anchors: DataFrame, log: str, judge: Callable[[DataFrame], DataFrame], k: int = 8, floor: float = 0.5, steps: int = 16) -> int:
    """Judges all candidates in steps and appends (a, b, relation, confidence) of each step to the log, a folder; returns the rows it added.

    A step is one append of Parquet files that appear whole, so that a pass that is stopped goes on with what the log lacks.
    Rows without a relation were not understood; they are not logged and come again in the next pass.
    """
    spark = nodes.sparkSession
    spark.createDataFrame([], "a long, b long, relation string, confidence double").write.mode("append").parquet(log)
    read = lambda: spark.read.schema("a long, b long, relation string, confidence double").parquet(log)
    before = read().count()
    todo, drop = written(linker_candidates(nodes, anchors, read(), k, floor).withColumn("step", F.pmod(F.xxhash64("a", "b"), F.lit(steps))))
    for step in sorted(r["step"] for r in todo.select("step").distinct().collect()):
        judge(todo.where(F.col("step") == step).drop("step")).where("relation is not null").select(*_pair(), "relation", F.col("confidence").cast("double").alias("confidence")).write.mode("append").parquet(log)
    drop()
    return read().count() - before
