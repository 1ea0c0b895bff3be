"""Streams read from files give what the batch forms give."""

import random

import pytest
from pyspark.sql import functions as F

from lorewell.operators import telemetry as batch
from lorewell.streaming import stages
from lorewell.streaming import telemetry as stream


def run(frame, name, spark, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_bucket_means(spark, tmp_path):
    rows = spark.range(240).select(F.timestamp_seconds(F.col("id") % 120).alias("ts"), F.when(F.col("id") < 120, "a").otherwise("b").alias("series"), (F.col("id") % 120 % 10).cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = run(stream.bucket_means(source, "10 seconds", "0 seconds"), "means", spark, "complete").collect()
    assert len(out) == 24 and {r.value for r in out} == {4.5} and {r.n for r in out} == {10}


def test_transitions_across_batches(spark, tmp_path):
    rows = [("j", float(t), r) for t, r in enumerate([False, True, True, False, True])]
    frame = spark.createDataFrame(rows, "job string, ts double, running boolean")
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, frame.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in run(stream.transitions(source), "jobs", spark, "append").collect()}
    want = {tuple(r) for r in batch.transitions(frame).collect()}
    assert {k for *_, k in got} == {"start", "end"} and got == want


def test_replayed_batch_adds_nothing(spark):
    known = spark.createDataFrame([(1,)], "id int")
    new = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert [r.id for r in stream.write_idempotently(new, known, "id").collect()] == [2]


def test_history_prometheus_and_schedule(spark):
    samples = spark.range(120).select((F.col("id") * 1.0).alias("ts"), F.lit("a").alias("series"), (F.col("id") % 10).cast("double").alias("value"))
    assert [r.value for r in batch.history(samples, 120.0, 2, 10).collect()] == [4.5] * 12
    lines = spark.createDataFrame([("# HELP x",), ('req{a="1"} 2',), ('req{a="2"} 3',), ("kv 0.25",), ("junk",), ("kv bad",)], "line string")
    got = {r.series: r.value for r in batch.prometheus(lines, {"req": ("requests", 1), "kv": ("cache", 100)}).collect()}
    assert got == {"requests": 5.0, "cache": 25.0}
    plan = spark.createDataFrame([(1, "a", False, 0.0, None, None), (2, "b", True, 100.0, 950.0, None), (3, "c", True, 10.0, 900.0, 2000.0), (4, "d", True, 10.0, None, None)], "position int, command string, enabled boolean, min_interval double, last_run double, hold_until double")
    assert batch.due_step(plan, 1000.0).first().command == "d"
    gpu = batch.gpu_rows(spark.createDataFrame([("0, 50, 1000, 2000, [N/A], 60",)], "line string")).collect()
    assert {r.metric for r in gpu} == {"util", "mem_used", "mem_total", "temp"}


def numbers(spark, folder, files=6, rows=20):
    for i in range(files):
        spark.range(i * rows, (i + 1) * rows).withColumn("text", F.concat(F.lit("t"), F.col("id"))).coalesce(1).write.mode("append").parquet(folder)
    return lambda: spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 2).parquet(folder)


def pipeline():
    return [stages.Stage("extract", lambda s: s.where("id % 5 <> 0").withColumn("words", F.split("text", " ")), files=1), stages.Stage("verify", lambda s: s.where("id % 2 = 0").select("id", F.size("words").alias("n")), files=2)]


def ids(frame):
    return sorted(r.id for r in frame.collect())


WANT = [i for i in range(120) if i % 5 and i % 2 == 0]


def test_stages_take_new_files_and_bounded_batches(spark, tmp_path):
    source = numbers(spark, str(tmp_path / "in"))
    assert ids(stages.run_stages(source(), pipeline(), str(tmp_path / "out"))) == WANT
    assert len(list((tmp_path / "out/extract/rows").glob("batch-*"))) == 3
    spark.range(1000, 1010).withColumn("text", F.lit("x y")).write.mode("append").parquet(str(tmp_path / "in"))
    assert ids(stages.run_stages(source(), pipeline(), str(tmp_path / "out"))) == [*WANT, 1002, 1004, 1006, 1008]
    assert stages.write_batch(spark.range(1), 0, str(tmp_path / "out/extract/rows")) is False


@pytest.mark.parametrize("when", ["before", "between", "after"])
def test_a_stage_killed_around_its_write_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, when):
    source, real, killed = numbers(spark, str(tmp_path / "in")), stages.write_batch, []

    def fragile(rows, number, folder):
        if number == 1 and len(killed) < 2 and folder.endswith(("extract/rows", "verify/rows")[len(killed)] if len(killed) < 2 else "-"):
            killed.append(folder)
            if when == "between":
                rows.write.parquet(f"{folder}/_drafts/lost{len(killed)}")
            if when == "after":
                real(rows, number, folder)
            raise RuntimeError("killed")
        return real(rows, number, folder)

    monkeypatch.setattr(stages, "write_batch", fragile)
    for _ in range(3):
        try:
            out = stages.run_stages(source(), pipeline(), str(tmp_path / "out"))
        except Exception as error:
            assert "killed" in str(error)
    assert len(killed) == 2 and ids(out) == WANT


def test_transitions_in_any_order_within_the_lateness(spark, tmp_path):
    for k, v in stream.ROCKS.items():
        spark.conf.set(k, v)
    rng = random.Random(6)
    rows = [(f"j{j}", 60 + 3 * t + j, rng.random() < 0.5) for j in range(3) for t in range(60)]
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 25))  # up to 25 seconds behind
    parts = [late[i : i + 30] for i in range(0, len(late), 30)] + [[("end", 5000, True)], [("end", 5001, True)]]
    schema = "job string, at long, running boolean"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:02d}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    try:
        out = run(stream.ordered_transitions(source.withColumn("ts", F.timestamp_seconds("at")), "30 seconds"), "ordered", spark)
        got = {(r.job, r.ts.timestamp(), r.kind) for r in out.where("job <> 'end'").collect()}
    finally:
        for k in stream.ROCKS:
            spark.conf.unset(k)
    frame = spark.createDataFrame([(j, float(t), r) for j, t, r in rows], "job string, ts double, running boolean")
    assert got == {tuple(r) for r in batch.transitions(frame).collect()} and len(got) > 60
