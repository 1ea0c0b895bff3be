"""A pipeline of streaming stages between tables, which loses and doubles nothing when it is killed.

Each stage is a Structured Streaming query with a bounded intake.  A micro-batch is written beside
its place and takes it by one rename, under its number; only then does Spark write the checkpoint.  A
batch that was written but not checkpointed is played again with the same rows, finds its place
taken and writes nothing, so that the next stage, which reads whole batches alone, sees each row once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stage:
    """``transform`` of a stream of what the stage before wrote; ``files`` are taken in a micro-batch at most."""

    name: str
    transform: Transform
    files: int = 16


def write_batch(rows: DataFrame, number: int, folder: str) -> bool:
    """Writes a micro-batch to its place below a folder that all executors share, unless it is there; gives whether it wrote.

    The file system's rename of a folder must be atomic and fail where the place is taken, as that of HDFS and POSIX is.
    """
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, draft = hadoop.Path(f"{folder}/batch-{number:012d}"), hadoop.Path(f"{folder}/_drafts/{uuid.uuid4().hex}")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place):
        return False
    rows.write.parquet(draft.toString())
    if not files.rename(draft, place):
        raise RuntimeError(f"{place} could not be taken")
    return True


def written_rows(spark: SparkSession, folder: str, stage: Stage, schema) -> DataFrame:
    """What a stage has written so far."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/{stage.name}/rows")


def start_stage(stream: DataFrame, stage: Stage, folder: str, once: bool = True) -> tuple[StreamingQuery, DataFrame]:
    """The query of one stage, and the stream of what it writes, for the next."""
    spark = stream.sparkSession
    out = stage.transform(stream)
    rows = f"{folder}/{stage.name}/rows"
    path = spark._jvm.org.apache.hadoop.fs.Path(rows)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    writer = out.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, rows)).option("checkpointLocation", f"{folder}/{stage.name}/checkpoint").queryName(f"{stage.name}_{uuid.uuid4().hex[:8]}")
    query = (writer.trigger(availableNow=True) if once else writer).start()
    return query, spark.readStream.schema(out.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", stage.files).parquet(rows)


def run_stages(source: DataFrame, stages: list[Stage], folder: str, seconds: float | None = None) -> DataFrame:
    """Runs the stages one after the other over all that is there, and gives what the last one has written.

    ``source`` is a stream, whose own options bound its intake.  A run that fails is run again with the same folder.
    """
    stream, last = source, None
    for stage in stages:
        query, following = start_stage(stream, stage, folder)
        query.awaitTermination() if seconds is None else query.awaitTermination(seconds)
        stream, last = following, stage
    return written_rows(source.sparkSession, folder, last, stream.schema)
