"""Vectors joined block by block: bounded blocks meet in tasks, blocks that lie too far apart are left out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.session import written

#: Rows of a block, and the most pivots that blocks lie around.
BLOCK, MOST_PIVOTS = 4_096, 1_024
#: A tie that no id reaches: rows that equal the floor count.
ANY = 1 << 62


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _celled(frame: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot of each vector (cell) and its distance from it (far)."""
    own = frame.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        p = own.value
        square = (p * p).sum(1)
        for batch in batches:
            v = _matrix(pa.chunked_array([batch.column("vec")]))
            apart = square - 2 * (v @ p.T) + (v * v).sum(1)[:, None]
            cell = apart.argmin(1)
            far = np.sqrt(np.maximum(0, ((v - p[cell]) ** 2).sum(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return frame.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + ", cell int, far double")


def _kernel(earlier: bool):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "id", "score"])
        ids, asked = right["id"].to_numpy(), left["id"].to_numpy()
        keep, floor, tie = (left[c].to_numpy() for c in ("keep", "floor", "tie"))
        q, v = _matrix(left["vec"]), _matrix(right["vec"])
        parts = []
        for at in range(0, len(q), 256):
            cut = slice(at, at + 256)
            score = np.round(q[cut] @ v.T, 9)
            fits = (score > floor[cut, None]) | ((score == floor[cut, None]) & (ids[None, :] <= tie[cut, None]))
            fits &= (ids[None, :] < asked[cut, None]) if earlier else (ids[None, :] != asked[cut, None])
            score[~fits] = -np.inf
            most = int(keep[cut].max())
            if 0 < most < len(ids):
                fits &= score >= np.partition(score, len(ids) - most, axis=1)[:, [len(ids) - most]]
            i, j = np.nonzero(fits)
            order = np.lexsort((ids[j], -score[i, j], i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            ok = place < keep[cut][i]
            i, j = i[ok], j[ok]
            parts.append((asked[cut][i], ids[j], score[i, j]))
        return pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], names=["query_id", "id", "score"])

    return best


def near_in_blocks(queries: DataFrame, vectors: DataFrame, earlier: bool = False, size: int = BLOCK) -> DataFrame:
    """(query_id, id, score): for each query a superset of its best vectors, by dot product to nine decimals.

    Queries (id, vec, keep, floor, tie) and vectors (id, vec) have whole numbers as ids; null vectors take no part,
    nor does a vector with the query's own id.  A row counts above the query's floor, or at it
    with an id up to ``tie``; ``earlier`` asks for ids below the query's.  Of each block a query gets
    its ``keep`` best rows, the smaller id first of equal ones.

    Rows lie around pivots, which are vectors in the order of a hash, ``MOST_PIVOTS`` of them at most, so that
    the driver sees those alone.  What lies around one pivot is dealt by hash into blocks of about ``size`` rows,
    whatever a pivot holds.  Two cells meet only if their centres' product and their radii allow a score at the
    lowest floor.  No block, and no task, holds more than a block of each side.
    """
    queries = queries.where("vec is not null").select("id", "vec", F.col("keep").cast("int").alias("keep"), F.col("floor").cast("double").alias("floor"), F.col("tie").cast("long").alias("tie"))
    vectors = vectors.where("vec is not null").select("id", "vec")
    n, n_asked = vectors.count(), queries.count()
    number = F.pmod(F.xxhash64("id"), F.lit(1)).cast("long")  # one group
    if n <= size and n_asked <= size:
        left, right = queries.withColumns({"q": number, "v": number}), vectors.withColumns({"q": number, "v": number})
        return _met(left, right, earlier)
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, -(-max(n, n_asked) // size))).select("vec").collect()
    if not chosen:
        return _met(queries.limit(0).withColumns({"q": number, "v": number}), vectors.withColumns({"q": number, "v": number}), earlier)
    pivots = np.array([r["vec"] for r in chosen], np.float64)
    left, right = (written(_celled(f, pivots))[0] for f in (queries, vectors))
    asked = left.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n"), F.min("floor").alias("floor")).collect()
    held = right.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()
    a, b = np.array([r["cell"] for r in asked], int), np.array([r["cell"] for r in held], int)
    ra, rb = np.array([r["far"] for r in asked], float)[:, None], np.array([r["far"] for r in held], float)[None, :]
    length = np.sqrt((pivots**2).sum(1))
    bound = pivots[a] @ pivots[b].T + ra * length[b][None, :] + rb * length[a][:, None] + ra * rb
    i, j = np.nonzero(bound + 1e-6 >= np.array([r["floor"] for r in asked], float)[:, None]) if len(a) and len(b) else ([], [])
    spark = queries.sparkSession
    parts = lambda rows, k: -(-rows[k]["n"] // size)
    routes = spark.createDataFrame([(int(a[x]), int(b[y]), parts(asked, x), parts(held, y)) for x, y in zip(i, j, strict=True)], "qcell int, vcell int, qparts int, vparts int")
    met = routes.select("qcell", "vcell", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)).alias("x"), "vparts").select("qcell", "x", "vcell", F.explode(F.sequence(F.lit(0), F.col("vparts") - 1)).alias("y"))
    met = met.select((F.col("qcell").cast("long") * ANYPARTS + F.col("x")).alias("q"), (F.col("vcell").cast("long") * ANYPARTS + F.col("y")).alias("v"))

    def blocked(frame: DataFrame, rows: list, name: str) -> DataFrame:
        sizes = spark.createDataFrame([(r["cell"], parts(rows, k)) for k, r in enumerate(rows)], "cell int, parts int")
        return frame.join(F.broadcast(sizes), "cell").withColumn(name, F.col("cell").cast("long") * ANYPARTS + F.pmod(F.xxhash64("id"), F.col("parts"))).drop("cell", "far", "parts")

    return _met(blocked(left, asked, "q").join(met, "q"), blocked(right, held, "v").join(met, "v"), earlier)


#: Above the blocks of one cell.
ANYPARTS = 1 << 40


def _met(left: DataFrame, right: DataFrame, earlier: bool) -> DataFrame:
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of one table on both sides are not told apart
    return left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(_kernel(earlier), "query_id long, id long, score double")
