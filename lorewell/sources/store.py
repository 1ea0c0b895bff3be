"""A store of chunks and their vectors: Parquet tables in buckets of the id, replaced bucket by bucket.

A change writes the buckets that it touches to new folders, so that its cost follows the change and not
the store, and then makes one version of both tables of them (``snapshots``): a reader sees chunks
and vectors of the old or the new version, whole, and of two changes at once one gets a conflict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import ingest, library, search
from lorewell.session import written
from lorewell.sources.snapshots import Snapshots

#: The columns of a chunk.
FIELDS = ("id", "path", "title", "section", "text", "source_type", "tokens")
_CHUNK = "id string, path string, title string, section string, text string, source_type string, tokens int"
_VECTOR = "id string, vec array<double>"


class ChunkStore:
    """Tables ``chunks`` and ``vectors`` below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, version: int | None = None) -> None:
        """The store at its last version, or as it was at another one that was kept."""
        self.spark, self.folder, self.buckets, self.version = spark, folder, buckets, version
        self.table = Snapshots(spark, folder)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, of some buckets alone if they are given."""
        schema = {"chunks": _CHUNK, "vectors": _VECTOR}[name]
        places = sorted({p for b, p in state.get(name, {}).items() if buckets is None or int(b) in buckets})
        if not places:
            return self.spark.createDataFrame([], schema)
        wanted = [f"{self.folder}/{p}" for p in places]
        return self.spark.read.schema(schema).parquet(*wanted)

    def chunks(self) -> DataFrame:
        return self._read(self.table.read(self.version)[1], "chunks")

    def vectors(self) -> DataFrame:
        return self._read(self.table.read(self.version)[1], "vectors")

    def _replaced(self, state: dict, name: str, rows: DataFrame, touched: list[int]) -> dict[str, str]:
        """Where the buckets of a table lie once the touched ones hold these rows; one without rows has no place."""
        folder = self.table.fresh(name)
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{folder}")
        full = [r["bucket"] for r in self.spark.read.schema("bucket int").parquet(f"{self.folder}/{folder}").distinct().collect()] if rows.limit(1).count() else []
        left = {b: p for b, p in state.get(name, {}).items() if int(b) not in touched}
        return left | {str(b): f"{folder}/bucket={b}" for b in full}

    def _touched(self, ids: DataFrame) -> list[int]:
        return [r["b"] for r in ids.select(self._bucket().alias("b")).distinct().collect()]

    def add(self, new: DataFrame, order: str | None = None, dim: int = 0) -> int:
        """Upsert of chunks: the last of several of one id counts, and a replaced one loses its vector.  Gives the version.

        With ``dim``, the new chunks get vectors of hashed words of so many dimensions.
        """
        base, state = self.table.read()
        fresh, drop = written(new)
        touched = self._touched(fresh)
        merged = ingest.upsert(self._read(state, "chunks", touched), fresh, "id", order).select(*FIELDS)
        vectors = ingest.kept_vectors(self._read(state, "vectors", touched), fresh, "id")
        if dim:
            last = ingest.upsert(fresh.limit(0), fresh, "id", order)
            vectors = vectors.unionByName(library.hash_vectors(last, "id", "text", dim).where("vec is not null"))
        after = {"vectors": self._replaced(state, "vectors", vectors, touched), "chunks": self._replaced(state, "chunks", merged, touched)}
        drop()
        return self.table.commit(base, after)

    def delete(self, gone: DataFrame, by: str = "path") -> int:
        """Chunks whose path (or other column) is listed go, and so do their vectors.  Gives the version."""
        base, state = self.table.read()
        lost, drop = written(self._read(state, "chunks").join(gone.select(by).distinct(), by, "left_semi").select("id"))
        touched = self._touched(lost)
        after = {name: self._replaced(state, name, self._read(state, name, touched).join(lost, "id", "left_anti"), touched) for name in ("vectors", "chunks")}
        drop()
        return self.table.commit(base, after)

    def search_text(self, queries: DataFrame, k: int = 10, source_type: str | None = None, title: str | None = None) -> DataFrame:
        """(query_id, id, score, rank) by BM25 over text, title and section, among the chunks that the filters let through."""
        rows, columns = self.chunks(), {"text": 1.0, "title": 4.0, "section": 2.0}
        allowed = library.chunk_filter(rows, source_type, title) if source_type or title else None
        return search.bm25(search.postings(rows, columns, "id"), queries, k, size=search.corpus_size(rows, columns, "id"), allowed=allowed)

    def search_vector(self, queries: DataFrame, k: int = 10, source_type: str | None = None) -> DataFrame:
        """(query_id, id, score, rank) by cosine, of one type of source if it is given."""
        rows = self.vectors() if source_type is None else self.vectors().join(library.chunk_filter(self.chunks(), source_type).select("id"), "id", "left_semi")
        return search.vector_search(rows, queries, k)
