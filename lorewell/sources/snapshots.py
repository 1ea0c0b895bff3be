"""Versions of tables: data folders are written first and never changed, then one small file names those of a version.

A version's file appears by one rename that fails if the version exists, so that a reader has the old or
the new version whole, a crash before the rename leaves the old one, and of two writers that started from
the same version one gets a :class:`Conflict`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class Snapshots:
    """The versions of what lies below a folder that all executors share; a version's state is a JSON object."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("_versions")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("_versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """The number and state of a version, by default the last one; before the first, 0 and an empty state."""
        number = max(self.versions(), default=0) if version is None else version
        if not number:
            return 0, {}
        stream = self._fs.open(self._path(f"_versions/{number}.json"))
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, state: dict) -> int:
        """Makes ``state`` the version after ``base``; raises :class:`Conflict` if there is one."""
        target, draft = self._path(f"_versions/{base + 1}.json"), self._path(f"_versions/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, False)
        out.write(json.dumps(state, sort_keys=True).encode())
        out.close()
        gateway = self.spark.sparkContext._gateway
        plain = gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        context = self._hadoop.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, plain)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                raise Conflict(f"{self.folder}: version {base + 1} exists") from error
            raise
        return base + 1

    def fresh(self, name: str) -> str:
        """A new folder's name, relative to the tables' own."""
        return f"data/{name}/{uuid.uuid4().hex}"

    def write(self, frame: DataFrame, name: str, **options) -> str:
        """Writes rows to a new folder and gives its name; no version has it yet."""
        place = self.fresh(name)
        frame.write.options(**options).parquet(f"{self.folder}/{place}")
        return place

    def vacuum(self, keep: int = 2) -> int:
        """Drops all but the last ``keep`` versions, and the data that those alone name; gives the folders dropped."""
        versions = self.versions()
        old, new = versions[:-keep] if keep else versions, versions[-keep:] if keep else []
        live = {p for v in new for p in _places(self.read(v)[1])}
        gone = {p for v in old for p in _places(self.read(v)[1])} - live
        for place in gone:
            self._fs.delete(self._path(place), True)
        for v in old:
            self._fs.delete(self._path(f"_versions/{v}.json"), False)
        return len(gone)


def _places(state) -> set[str]:
    if isinstance(state, str):
        return {state} if state.startswith("data/") else set()
    parts = state.values() if isinstance(state, dict) else state if isinstance(state, list) else []
    return {p for x in parts for p in _places(x)}


def publish(frame: DataFrame, folder: str, expected: int | None = None) -> int:
    """Writes a table beside the one that is read, checks its count, and makes it the table's next version; gives the rows written."""
    spark = frame.sparkSession
    table = Snapshots(spark, folder)
    base, _ = table.read()
    place = table.write(frame, "rows")
    n = spark.read.parquet(f"{folder}/{place}").count()
    if expected is not None and n != expected:
        table._fs.delete(table._path(place), True)
        raise ValueError(f"{folder}: {n} rows, not {expected}")
    table.commit(base, {"rows": place})
    return n


def published(spark: SparkSession, folder: str, version: int | None = None, where: Column | None = None) -> DataFrame:
    """The rows of a published table, of its last version or of another that was kept."""
    _, state = Snapshots(spark, folder).read(version)
    rows = spark.read.parquet(f"{folder}/{state['rows']}")
    return rows if where is None else rows.where(where)
