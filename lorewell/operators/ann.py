"""Approximate nearest neighbours: product codes in cells of centroids, and graphs searched by beam.

Both are tables.  What is fitted is fitted on a bounded sample; every vector is indexed.  A search
joins the index with its queries in cells of bounded size, and best rows of each cell are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.operators.search import DIGITS, _matrix, dot, scored_vectors, top_k
from lorewell.session import saved, written

#: Vectors that centroids and codes are fitted on, at most; every vector is indexed.
SAMPLE = 20_000
#: Cells at most, components of a sub-vector, codes of one, and rows of a cell that are scored together.
MOST_CELLS, WIDTH, CODES, CHUNK = 4096, 4, 256, 1 << 16
#: The share of true neighbours that the probed cells hold on the sample, and candidates that are scored exactly for each result.
WANTED, SHORTLIST = 0.97, 20
#: Vectors of one graph, nearest neighbours that a node links to, and links that it keeps with those of others.
GRAPH_ROWS, NEAR, LINKS = 1 << 14, 16, 32
#: Queries that meet a part of an index at once.
QUERIES = 10_000


def _sample(vectors: DataFrame) -> np.ndarray:
    rows = vectors.where("vec is not null").orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").collect()
    return np.array([r["vec"] for r in rows], np.float32)


def _means(x: np.ndarray, k: int, rounds: int, rng, sphere: bool) -> np.ndarray:
    """k centres of rows; on the unit sphere by dot product, else by distance."""
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = (x @ centre.T - (0 if sphere else (centre**2).sum(axis=1) / 2)).argmax(axis=1)
        n = np.bincount(own, minlength=len(centre))
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
        if sphere:
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return centre


@dataclass
class Quantiser:
    """Centroids of cells, codebooks of the residuals' sub-vectors, and how many cells a query probes."""

    centre: np.ndarray
    books: np.ndarray
    probes: int

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, k: int = 10, seed: int = 3) -> Quantiser:
        """As many cells as the root of the table's rows; as many probes as find WANTED of the sample's own neighbours."""
        rng = np.random.default_rng(seed)
        cells = int(min(MOST_CELLS, max(1, round(rows**0.5)), max(1, len(x) // 4)))
        centre = _means(x, cells, 8, rng, True)
        own = (x @ centre.T).argmax(axis=1)
        parts = -(-x.shape[1] // WIDTH)
        rest = np.zeros((len(x), parts * WIDTH), np.float32)
        rest[:, : x.shape[1]] = x - centre[own]
        books = np.stack([_means(rest[:, j * WIDTH : (j + 1) * WIDTH], min(CODES, len(x)), 6, rng, False) for j in range(parts)])
        asked = rng.permutation(len(x))[:200]
        score = x[asked] @ x.T
        near = np.argpartition(-score, min(k, len(x) - 1), axis=1)[:, :k]
        order = np.argsort(np.argsort(-(x[asked] @ centre.T), axis=1), axis=1)  # place of each cell for each query
        place = np.sort(np.take_along_axis(order, own[near], axis=1).ravel())
        return cls(centre, books, int(place[min(len(place) - 1, int(WANTED * len(place)))]) + 1)

    def cells(self, x: np.ndarray, n: int) -> np.ndarray:
        score = x @ self.centre.T
        return np.argsort(-score, axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code bytes of each row."""
        x = x.astype(np.float32)
        cell = (x @ self.centre.T).argmax(axis=1)
        rest = np.zeros((len(x), self.books.shape[0] * WIDTH), np.float32)
        rest[:, : x.shape[1]] = x - self.centre[cell]
        code = np.empty((len(x), len(self.books)), np.uint8)
        for j, book in enumerate(self.books):
            code[:, j] = (rest[:, j * WIDTH : (j + 1) * WIDTH] @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1)
        return cell, code

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(query, sub-vector, code): what each code adds to the score."""
        padded = np.zeros((len(q), self.books.shape[0] * WIDTH), np.float32)
        padded[:, : q.shape[1]] = q
        return np.einsum("qjw,jcw->qjc", padded.reshape(len(q), -1, WIDTH), self.books)


@dataclass
class CodeIndex:
    """``codes``: (id, cell, salt, code), stored in the order of cells, ``sizes``: (cell, salts), and what made them."""

    codes: DataFrame
    sizes: DataFrame
    model: Quantiser | None


def _plain_schema(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def build_codes(vectors: DataFrame, k: int = 10) -> CodeIndex:
    """The product codes of vectors (id, vec); null vectors are left out.  A cell of many rows is cut into salted chunks."""
    spark = vectors.sparkSession
    rows = vectors.select("id", "vec").where("vec is not null")
    n = rows.count()
    model = Quantiser.fit(_sample(rows), n, k) if n else None
    kind = _plain_schema(rows, "id")
    shared = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, code = shared.value.encode(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "cell", "code"])

    coded = saved(rows.mapInArrow(encode, f"id {kind}, cell int, code binary"))
    sizes = saved(coded.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("salts")))
    dealt = coded.join(F.broadcast(sizes), "cell").select("id", "cell", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), "code")  # a row a cell, MOST_CELLS at most
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    codes, _ = written(dealt.repartitionByRange(parts, "cell", "salt").sortWithinPartitions("cell", "salt"))
    return CodeIndex(codes, sizes, model)


def code_search(index: CodeIndex, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank, scored): the k best rows of the cells that a query (query_id, qvec) probes.

    Cells are scored by codes from a table of each query, the SHORTLIST * k best then by their
    vectors; ``scored`` counts the codes that a query was held against.
    """
    if index.model is None:
        return queries.select("query_id").join(vectors.select("id"), F.lit(False)).select("query_id", "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("scored"))
    spark = vectors.sparkSession
    shared, n = spark.sparkContext.broadcast(index.model), probes or index.model.probes
    q_kind, kind, most = _plain_schema(queries, "query_id"), _plain_schema(vectors, "id"), SHORTLIST * k

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.cells(_matrix(batch.column(1)), n)
                at = pa.array(np.repeat(np.arange(len(cells)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cells.ravel().astype(np.int32))], names=["query_id", "qvec", "cell"])

    def score(codes: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if codes.num_rows and asked.num_rows:
            model, code = shared.value, np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(codes.num_rows, -1)
            for at in range(0, asked.num_rows, 256):
                part = asked.slice(at, 256)
                q = _matrix(part["qvec"].combine_chunks())
                base, table = q @ model.centre[codes["cell"][0].as_py()], model.tables(q)
                for i in range(len(q)):
                    s = base[i] + table[i][np.arange(code.shape[1]), code].sum(axis=1)
                    best = np.argpartition(-s, most)[:most] if len(s) > most else np.arange(len(s))
                    out.append(pa.table([part["query_id"].take(pa.array(np.full(len(best), i))), codes["id"].take(pa.array(best)), pa.array(s[best].astype(np.float64)), pa.array(np.full(len(best), len(s)))], names=["query_id", "id", "near", "held"]))
        return pa.concat_tables(out) if out else pa.table([asked["query_id"].slice(0, 0), codes["id"].slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.int64())], names=["query_id", "id", "near", "held"])

    asked = queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")).where("qvec is not null")
    probed = saved(asked.mapInArrow(probe, f"query_id {q_kind}, qvec array<double>, cell int").join(F.broadcast(index.sizes), "cell").select("query_id", "qvec", "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // QUERIES)))).cast("int")
    blocks = probed.withColumn("block", block)
    held = index.codes.join(F.broadcast(saved(blocks.select("cell", "block").distinct())), "cell")  # a row a cell and block
    near = saved(held.groupBy("cell", "salt", "block").cogroup(blocks.groupBy("cell", "salt", "block")).applyInArrow(score, f"query_id {q_kind}, id {kind}, near double, held long"))
    short = top_k(near.select("query_id", "id", F.col("near").alias("score")), most).select("query_id", "id")
    counted = probed.join(index.codes.groupBy("cell", "salt").agg(F.count("*").alias("c")), ["cell", "salt"]).groupBy("query_id").agg(F.sum("c").alias("scored"))
    exact = short.join(vectors.select("id", "vec"), "id").join(asked, "query_id").select("query_id", "id", F.round(dot(F.col("vec"), F.col("qvec")), 9).alias("score"))
    return top_k(exact, k).join(counted, "query_id")


def ivf_search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank) by product codes, over an index that is built for these queries."""
    return code_search(build_codes(vectors, k), vectors, queries, k).drop("scored")


def _links(x: np.ndarray) -> list[np.ndarray]:
    """Each row's NEAR nearest rows and those that it is nearest to, the LINKS closest of them."""
    n, own = len(x), min(NEAR, len(x) - 1)
    pairs = []
    for first in range(0, n, 1024):
        score = x[first : first + 1024] @ x.T
        score[np.arange(len(score)), np.arange(first, first + len(score))] = -np.inf
        near = np.argpartition(-score, own - 1, axis=1)[:, :own] if own else np.zeros((len(score), 0), int)
        a = np.repeat(np.arange(first, first + len(score)), own)
        s = np.take_along_axis(score, near, axis=1).ravel()
        pairs.append((a, near.ravel(), s))
    a, b, s = (np.concatenate([p[i] for p in pairs]) for i in range(3))
    both = np.unique(np.c_[np.r_[a, b], np.r_[b, a]], axis=0, return_index=True)[1]
    a, b, s = np.r_[a, b][both], np.r_[b, a][both], np.r_[s, s][both]
    order = np.lexsort((b, -s, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < LINKS
    a, b = a[keep], b[keep]
    return np.split(b, np.searchsorted(a, np.arange(1, n)))


def build_graph(vectors: DataFrame) -> DataFrame:
    """(part, node, id, vec, near): a small-world graph of each GRAPH_ROWS vectors or so, whose nodes link to their nearest ones in both directions.

    Parts are dealt by the id's hash, so that no part grows with a hot key; the table is stored by part.
    """
    rows = vectors.select("id", F.col("vec").cast("array<float>").alias("vec")).where("vec is not null")
    parts = max(1, -(-rows.count() // GRAPH_ROWS))
    kind = _plain_schema(rows, "id")

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        near = _links(_matrix(table["vec"].combine_chunks()).astype(np.float32))
        return pa.table([table["part"], pa.array(np.arange(table.num_rows, dtype=np.int32)), table["id"], table["vec"], pa.array([v.astype(np.int32) for v in near], pa.list_(pa.int32()))], names=["part", "node", "id", "vec", "near"])

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return written(dealt.groupBy("part").applyInArrow(link, f"part int, node int, id {kind}, vec array<float>, near array<int>"))[0]


def beam(x: np.ndarray, links: list[np.ndarray], entries: np.ndarray, q: np.ndarray, width: int) -> tuple[list[tuple[float, int]], int]:
    """The ``width`` best nodes that a best-first walk finds from the best of some entries, and how many scores it took."""
    seen = np.zeros(len(x), bool)
    seen[entries] = True
    score = x[entries] @ q
    best = [(float(s), int(i)) for s, i in zip(score, entries, strict=True)]
    heapq.heapify(best)
    while len(best) > width:
        heapq.heappop(best)
    todo, taken = [(-s, i) for s, i in best], len(entries)
    heapq.heapify(todo)
    while todo:
        s, i = heapq.heappop(todo)
        if len(best) >= width and -s < best[0][0]:
            break
        new = links[i][~seen[links[i]]]
        seen[new] = True
        taken += len(new)
        for t, j in zip((x[new] @ q).tolist(), new.tolist(), strict=True):
            if len(best) < width:
                heapq.heappush(best, (t, j))
            elif t > best[0][0]:
                heapq.heapreplace(best, (t, j))
            else:
                continue
            heapq.heappush(todo, (-t, j))
    return sorted(best, reverse=True), taken


def graph_search(graph: DataFrame, queries: DataFrame, k: int = 10, width: int | None = None, entries: int = 8) -> DataFrame:
    """(query_id, id, score, rank, scored): the k best nodes that beams through all parts of a graph find for each query (query_id, qvec).

    A part walks from ``entries`` nodes with ``width`` at hand, by default one in 80 of its nodes; ``scored`` counts the vectors that a query was held against.
    """
    q_kind, kind = _plain_schema(queries, "query_id"), _plain_schema(graph, "id")

    def walk(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if nodes.num_rows and asked.num_rows:
            nodes = nodes.sort_by("node")
            x = _matrix(nodes["vec"].combine_chunks()).astype(np.float32)
            links = [np.array(v, np.int64) for v in nodes["near"].to_pylist()]
            start = np.unique(np.linspace(0, len(x) - 1, min(entries, len(x))).astype(int))
            for i, q in enumerate(_matrix(asked["qvec"].combine_chunks()).astype(np.float32)):
                best, taken = beam(x, links, start, q, max(width or len(x) // 80, k))
                rows += [(i, j, taken) for _, j in best[:k]]
        at, own = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())
        return pa.table([asked["query_id"].take(at), nodes["id"].take(own), nodes["vec"].take(own), pa.array([r[2] for r in rows], pa.int64())], names=["query_id", "id", "vec", "taken"])

    asked = queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")).where("qvec is not null")
    blocks = max(1, -(-asked.count() // QUERIES))
    parts = graph.select("part").distinct()
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    # Every query meets every part: a stated set of queries, in blocks.
    left = graph.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.withColumn("block", block).crossJoin(F.broadcast(saved(parts.select(F.col("part").alias("p"))))).withColumnRenamed("p", "part")
    found = saved(left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(walk, f"query_id {q_kind}, id {kind}, vec array<float>, taken long"))
    counted = found.groupBy("query_id", F.pmod(F.xxhash64("id"), F.lit(max(1, parts.count()))).alias("part")).agg(F.first("taken").alias("taken")).groupBy("query_id").agg(F.sum("taken").alias("scored"))
    exact = found.join(asked, "query_id").select("query_id", "id", F.round(dot(F.col("vec"), F.col("qvec")), 9).alias("score"))
    return top_k(exact, k).join(counted, "query_id")


def exact_search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = DIGITS) -> DataFrame:
    """(query_id, id, score, rank): what ``graph_search`` finds, completed by the rows that its beams missed.

    The k-th score of a query's beams is one that its k best reach; a pass over the vectors keeps
    the rows above it, which are few where the beams found most.  Rows are ranked by scores of
    ``digits``, then by id.
    """
    near = graph_search(graph, queries, k).where(F.col("rank") == k - 1)
    # Beams are scored by another sum, whose ninth digit may differ; fewer digits may take half of the last one off the k-th score.
    slack = 2e-9 + (10.0**-digits if digits < DIGITS else 0.0)
    least = saved(near.select("query_id", (F.col("score") - slack).alias("least")))
    asked = queries.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return top_k(scored_vectors(vectors.select("id", "vec"), asked, k, digits=digits), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact (query_id, id) that was found."""
    hit = exact.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    return hit / max(1, exact.count())
