"""A text index that is kept and extended: immutable segments of postings in the order of terms.

A batch of documents is one more segment.  Deleted and replaced documents are tombstones (id, number),
which hide the rows of segments below that number.  Segments of about one size are merged once
there are a few of them, which drops what is hidden.  All of it is versioned by ``snapshots``: a
search reads one version, whatever is added meanwhile.

A segment is dealt by ranges of terms and written in small row groups, so that a search for some terms
reads the row groups whose range of terms holds one of them.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.functions.stemming import stemmed, unmarked
from lorewell.operators import search
from lorewell.session import written
from lorewell.sources.snapshots import Snapshots

#: Segments of one tier that are merged, the ratio of sizes of tiers, terms that a scan is pruned for, and bytes of a row group.
MERGED, TIER, PRUNED_TERMS, GROUP_BYTES = 4, 4, 256, 1 << 20
#: Tombstones that are broadcast, at most.
BROADCAST_ROWS = 1_000_000


def _any(parts: list[Column]) -> Column:
    """A balanced disjunction."""
    while len(parts) > 1:
        parts = [reduce(Column.__or__, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


class TextIndex:
    """BM25 over chunks with ``id`` and some text columns with weights, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, columns: dict[str, float], stems: bool = False) -> None:
        self.spark, self.columns, self.stems = spark, columns, stems
        self.table = Snapshots(spark, folder)

    def _read(self, place: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.table.folder}/{place}")

    def _dead(self, state: dict) -> DataFrame | None:
        """(id, upto): rows of segments below ``upto`` are hidden."""
        if not state.get("tombstones"):
            return None
        dead = reduce(DataFrame.unionByName, [self._read(p) for p in state["tombstones"]])
        return dead.groupBy("id").agg(F.max("upto").alias("upto"))

    def _live(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows (id, number, ...) without hidden ones."""
        dead = self._dead(state)
        if dead is None:
            return rows
        hidden = dead.withColumnRenamed("id", "_id")
        hidden = F.broadcast(hidden) if state["hidden"] <= BROADCAST_ROWS else hidden
        return rows.join(hidden, (F.col("id") == F.col("_id")) & (F.col("number") < F.col("upto")), "left_anti")

    def _rows(self, state: dict, kind: str, segments: list[dict] | None = None) -> DataFrame | None:
        parts = [self._read(s[kind]).withColumn("number", F.lit(s["number"])) for s in (state["segments"] if segments is None else segments)]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _segment(self, postings: DataFrame, docs: DataFrame, number: int) -> dict:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        by_term = postings.repartitionByRange(parts, "term", "id").sortWithinPartitions("term", "id")
        place = self.table.write(by_term, "postings", **{"parquet.block.size": str(GROUP_BYTES), "parquet.page.size": str(GROUP_BYTES // 16)})
        out = {"postings": place, "docs": self.table.write(docs, "docs"), "number": number}
        return out | {"rows": self._read(place).count()}

    def _sized(self, state: dict) -> dict:
        """The state with the number of documents and words that a search can see."""
        docs = self._rows(state, "docs")
        n, words = self._live(docs, state).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first() if docs is not None else (0, 0)
        return state | {"docs": n, "words": words}

    def add(self, chunks: DataFrame) -> int:
        """One more segment; a document whose id is there is replaced.  Of rows of one id in ``chunks``, any one may count, so pass each once.  Gives the version."""
        base, state = self.table.read()
        state = {"segments": [], "tombstones": [], "hidden": 0, "next": 1} | state
        postings, drop = written(search.postings(chunks, self.columns, "id", self.stems))
        docs = postings.groupBy("id").agg(F.min("len").alias("len"))
        state = self._hide(state, chunks.select("id"))
        segment = self._segment(postings.select("term", "id", "wtf", "tf", "len"), docs, state["next"])
        drop()
        state = state | {"segments": [*state["segments"], segment], "next": state["next"] + 1}
        return self.table.commit(base, self._merged(self._sized(state)))

    def _hide(self, state: dict, ids: DataFrame) -> dict:
        docs = self._rows(state, "docs")
        if docs is None:
            return state
        known = self._live(docs, state).join(ids.distinct(), "id", "left_semi")
        place = self.table.write(known.select("id", F.lit(state["next"]).alias("upto")), "tombstones")
        n = self._read(place).count()
        return state | {"tombstones": [*state["tombstones"], place], "hidden": state["hidden"] + n} if n else state

    def delete(self, ids: DataFrame) -> int:
        """Documents (id) go from all later versions; gives the version."""
        base, state = self.table.read()
        if not state:
            return base
        hidden = self._hide(state, ids.select("id"))
        return self.table.commit(base, self._sized(hidden | {"next": state["next"] + 1}))

    def _merge(self, state: dict, chosen: list[dict]) -> dict:
        number = max(s["number"] for s in chosen)
        live = lambda kind: self._live(self._rows(state, kind, chosen), state).drop("number")
        merged = self._segment(live("postings").select("term", "id", "wtf", "tf", "len"), live("docs"), number)
        segments = sorted([s for s in state["segments"] if s not in chosen] + [merged], key=lambda s: s["number"])
        return state | {"segments": segments}

    def _merged(self, state: dict) -> dict:
        """Merges the segments of each tier of sizes that has MERGED of them, the smallest tier first."""
        while True:
            tiers: dict[int, list[dict]] = defaultdict(list)
            for s in state["segments"]:
                tier, size = 0, s["rows"]
                while size >= TIER * 1000:
                    tier, size = tier + 1, size // TIER
                tiers[tier].append(s)
            full = [t for t, own in sorted(tiers.items()) if len(own) >= MERGED]
            if not full:
                return state
            state = self._merge(state, tiers[full[0]])

    def optimise(self) -> int:
        """Merges all segments into one and forgets the tombstones; gives the version."""
        base, state = self.table.read()
        if len(state.get("segments", [])) < 2 and not state.get("tombstones"):
            return base
        return self.table.commit(base, self._merge(state, state["segments"]) | {"tombstones": [], "hidden": 0})

    def postings(self, terms: list[str] | None = None, version: int | None = None) -> DataFrame:
        """(id, term, wtf, tf, len) that a search sees; for some terms alone, the scan is pruned to row groups that can have them."""
        _, state = self.table.read(version)
        if not state.get("segments"):
            return self.spark.createDataFrame([], "id long, term string, wtf double, tf long, len long")
        rows = self._rows(state, "postings")
        if terms is not None and len(terms) <= PRUNED_TERMS:
            rows = rows.where(_any([F.col("term") == t for t in terms]) if terms else F.lit(False))
        return self._live(rows, state).select("id", "term", "wtf", "tf", "len")

    def size(self, version: int | None = None) -> DataFrame:
        """(docs, avg_len)."""
        _, state = self.table.read(version)
        n, words = state.get("docs", 0), state.get("words", 0)
        return self.spark.createDataFrame([(n, words / n if n else None)], "docs long, avg_len double")

    def search(self, queries: DataFrame, k: int = 10, version: int | None = None, stop: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, rank) by BM25 for queries (query_id, query), as ``operators.search.bm25`` over the same documents gives."""
        words = F.transform(T.search_terms(F.col("query")), lambda t: unmarked(F.lower(t)))
        asked = queries.select(F.explode(stemmed(words) if self.stems else words).alias("term")).distinct().limit(PRUNED_TERMS + 1).collect()
        terms = [r["term"] for r in asked] if len(asked) <= PRUNED_TERMS else None
        return search.bm25(self.postings(terms, version), queries, k, stop, self.size(version), self.stems)
