"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


#: Bytes of a table's files for each partition of the shuffles behind it, and of shuffled rows that small partitions are joined up to.
PARTITION_BYTES, ADVISORY, ADVISED = 4 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m"
#: Bytes of files that a task reads, which would otherwise grow with a table up to Spark's 128 MB.
SPLIT = "spark.sql.files.maxPartitionBytes"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the session's shuffle partitions are raised to its size and joined up to a fixed one, as its files are cut to, so that a task's share does not grow with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    parts = -(-size // PARTITION_BYTES)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    for key in (ADVISORY, SPLIT):
        if spark.conf.get(key, None) is None:  # a setting of the session's own holds
            spark.conf.set(key, ADVISED)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
