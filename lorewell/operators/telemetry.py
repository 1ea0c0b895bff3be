"""Telemetry: bucketed series, retention, job transitions, audit rollups, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucket_seconds(minutes: float, step: float = 0) -> tuple[float, float]:
    """(span, bucket) in seconds: about 600 points a series, a second at least."""
    span = max(60.0, minutes * 60)
    return span, max(step or span / 600, 1.0)


def history(samples: DataFrame, now: float, minutes: float, step: float = 0) -> DataFrame:
    """(series, at, value): means of (ts, series, value) in buckets from ``now - span``, at their centres."""
    span, bucket = bucket_seconds(minutes, step)
    start = now - span
    rows = samples.where(F.col("ts") >= start).withColumn("b", F.floor((F.col("ts") - start) / bucket))
    mean = rows.groupBy("series", "b").agg(F.avg("value").alias("v"))
    return mean.select("series", F.round(F.lit(start) + (F.col("b") + 0.5) * bucket, 1).alias("at"), (F.floor(F.round("v", 9) * 1000 + 0.5) / 1000).alias("value"))


def prune(samples: DataFrame, now: float, keep_days: float) -> DataFrame:
    return samples.where(F.col("ts") >= now - keep_days * 86400)


def long_samples(wide: DataFrame, at: str = "ts") -> DataFrame:
    """(ts, series, value) of a wide row a time; nulls are left out."""
    names = [c for c in wide.columns if c != at]
    return wide.unpivot(at, [F.col(c).cast("double").alias(c) for c in names], "series", "value").where("value is not null").withColumnRenamed(at, "ts")


def prometheus(lines: DataFrame, names: dict[str, tuple[str, float]]) -> DataFrame:
    """(series, value) of exposition lines (line): sums over label sets, by the names wanted and their scales."""
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{[^}]*\})?\s+([-+0-9.eE]+)\s*$"
    table = F.create_map(*[F.lit(x) for k, (v, _) in names.items() for x in (k, v)])
    scale = F.create_map(*[F.lit(x) for k, (_, s) in names.items() for x in (k, float(s))])
    rows = lines.select(F.regexp_extract("line", pattern, 1).alias("name"), F.expr(f"try_cast(regexp_extract(line, r'{pattern}', 3) as double)").alias("v"))
    kept = rows.where(F.col("name").isin(list(names)) & F.col("v").isNotNull())
    return kept.groupBy(F.try_element_at(table, "name").alias("series")).agg(F.sum(F.col("v") * F.try_element_at(scale, "name")).alias("value"))


def gpu_rows(lines: DataFrame) -> DataFrame:
    """(gpu, metric, value) of comma-separated GPU lines; values that are no numbers are left out."""
    names = ["util", "mem_used", "mem_total", "power", "temp"]
    parts = F.transform(F.split("line", ","), lambda x: F.trim(x))
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.get(parts, F.lit(i + 1)).alias("v")) for i, n in enumerate(names)])
    rows = lines.select(F.get(parts, F.lit(0)).alias("gpu"), F.explode(pairs).alias("p"))
    return rows.select("gpu", "p.metric", F.expr("try_cast(p.v as double)").alias("value")).where("value is not null")


def transitions(states: DataFrame) -> DataFrame:
    """(job, ts, kind): start and end where a job's running mark changes in (job, ts, running)."""
    w = Window.partitionBy("job").orderBy("ts")
    rows = states.withColumn("was", F.coalesce(F.lag("running").over(w), F.lit(False)))
    return rows.where(F.col("running") != F.col("was")).select("job", "ts", F.when(F.col("running"), "start").otherwise("end").alias("kind"))


def audit_rollup(log: DataFrame) -> DataFrame:
    """Per rule: requests, bytes, denied, auth_rejects, and the last time with its purpose."""
    return log.groupBy("rule").agg(
        F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.count_if(F.col("outcome") == "denied").alias("denied"),
        F.count_if(F.col("outcome") == "auth").alias("auth_rejects"), F.max("ts").alias("last_ts"), F.max_by("purpose", F.struct("ts", "purpose")).alias("last_purpose"),
    )


def tail(log: DataFrame, n: int, at: str = "ts", tie: str = "event_id") -> DataFrame:
    return log.orderBy(F.desc(at), F.desc(tie)).limit(n)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines; each append is files of its own."""
    rows.write.mode("append").json(path)


def read_log(spark, path: str, schema: str) -> DataFrame:
    """The whole log; lines that do not parse have nulls."""
    return spark.read.schema(schema).json(path)


def due_step(plan: DataFrame, now: float) -> DataFrame:
    """The first enabled step (position, command, enabled, min_interval, last_run, hold_until) that may run."""
    may = F.col("enabled") & (now - F.coalesce("last_run", F.lit(0.0)) >= F.col("min_interval")) & (F.coalesce("hold_until", F.lit(0.0)) <= now)
    return plan.where(may).orderBy("position").limit(1)
