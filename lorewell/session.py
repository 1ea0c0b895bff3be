"""A local session with the settings that the library is tested and measured with, and tables kept between plans."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "lorewell") -> SparkSession:
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LOREWELL_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session within one process (as in tests) has a folder of its own, and
    a cluster's raises an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "/tmp/checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def saved(frame: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; later plans start from there."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder's name below the shared one; it is deleted when the session ends."""
    folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(frame: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The rows as a Parquet table in the shared folder, read again, and what deletes it (the session's end does, too)."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(path)
    return spark.read.parquet(folder), lambda: store.delete(path, True)
