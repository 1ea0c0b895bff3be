"""Sparse, dense and hybrid search over chunks, many queries at a time.

Postings, lengths and document frequencies are tables; a batch of queries is joined with
them, so that one plan answers all queries.  Vectors are scored by matrix products over
Arrow batches, and a task sends on its own best rows of each query alone.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorewell.functions import text as T
from lorewell.functions.stemming import porter, stemmed, unmarked
from lorewell.session import saved, written

#: Fixed values of BM25: saturation, length normalisation, floor of the idf.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
#: Fixed values of a learned stoplist: its share of the documents, the fewest documents, the most terms.
STOP_RATIO, STOP_LEAST_DOCS, STOP_MOST = 0.5, 5000, 300
#: Rows of a table of query terms that is broadcast, and of queries that one pass over the vectors answers.
BROADCAST_ROWS, QUERY_BLOCK = 1_000_000, 10_000
#: Scores of documents and queries that a task holds at a time.
SCORE_CELLS = 1 << 22
#: Digits of a vector's score.
DIGITS = 9


def _words(text: Column) -> Column:
    """Words of a text as an index has them: lower-cased, without marks; an empty one at either end if a separator is there."""
    return F.split(unmarked(F.lower(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+")


def _sized(chunks: DataFrame, columns: dict[str, float], id_col: str, stems: bool = False) -> DataFrame:
    """(id, own.., len): the words of each column, and how many there are in all."""
    names = [f"w{i}" for i in range(len(columns))]
    words = [stemmed(_words(F.col(c))) if stems else _words(F.col(c)) for c in columns]
    rows = chunks.select(F.col(id_col).alias("id"), *[w.alias(n) for w, n in zip(words, names, strict=True)])
    full = lambda n: F.greatest(F.lit(0), F.size(n) - (F.get(n, F.lit(0)) == "").cast("int") - (F.element_at(n, -1) == "").cast("int"))
    return rows.select("*", reduce(Column.__add__, map(full, names)).cast("long").alias("len"))


def postings(chunks: DataFrame, columns: dict[str, float], id_col: str = "doc_id", stems: bool = False) -> DataFrame:
    """(id, term, wtf, tf, len): weighted and plain term frequencies over the text columns, and the document's length.

    The columns' words are one array, whose places tell the weight; the length travels with
    each row, so that scores need no further join.  Texts are dealt by id before they are cut
    into words, which are more bytes than they and then stay where they are.  ``stems`` indexes
    Porter stems.
    """
    rows = _sized(chunks.select(F.col(id_col).alias("id"), *columns).repartition("id"), columns, "id", stems)
    names = [c for c in rows.columns if c not in ("id", "len")]
    weight, end = F.lit(0.0), F.lit(0)
    ends = []
    for n in names:
        end = end + F.size(n)
        ends.append(end)
    for e, w in reversed(list(zip(ends, columns.values(), strict=True))):
        weight = F.when(F.col("pos") < e, F.lit(float(w))).otherwise(weight)
    one = rows.select("id", "len", *names, F.concat(*names).alias("all"))
    each = one.select("id", "len", *names, F.posexplode_outer("all").alias("pos", "term")).where("term <> ''")
    return each.select("id", "len", "term", weight.alias("w")).groupBy("id", "len", "term").agg(F.sum("w").alias("wtf"), F.count("*").alias("tf"))


def corpus_size(chunks: DataFrame, columns: dict[str, float], id_col: str = "doc_id", stems: bool = False) -> DataFrame:
    """(docs, avg_len) of the documents with a word, in one pass without a shuffle of rows."""
    # A filter would be pushed below the words, which would then be made for each of its parts.
    full = F.when(F.col("len") > 0, F.col("len"))
    return _sized(chunks, columns, id_col, stems).agg(F.count(full).alias("docs"), F.avg(full).alias("avg_len"))


def build_index(chunks: DataFrame, columns: dict[str, float], id_col: str = "doc_id", stems: bool = False) -> DataFrame:
    """The postings as a table in the shared folder."""
    return written(postings(chunks, columns, id_col, stems))[0]


def index_size(index: DataFrame) -> DataFrame:
    """(docs, avg_len) from postings alone: a row a document and task is shuffled."""
    return index.groupBy("id").agg(F.min("len").alias("len")).agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))


def stoplist(index: DataFrame, ratio: float = STOP_RATIO, least_docs: int = STOP_LEAST_DOCS, most: int = STOP_MOST, extras: list[str] | None = None, size: DataFrame | None = None) -> DataFrame:
    """(term, df): terms of more than ``ratio`` of the documents, the most frequent first, and the extra ones."""
    n = index_size(index) if size is None else size
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    found = df.crossJoin(F.broadcast(n)).where((F.col("docs") >= least_docs) & (F.col("df") > F.floor(F.col("docs") * ratio))).orderBy(F.desc("df"), "term").limit(most).select("term", "df")
    if not extras:
        return found
    more = index.sparkSession.createDataFrame([(t,) for t in sorted({t.lower() for t in extras})], "term string")
    return found.unionByName(more.join(found, "term", "left_anti").select("term", F.lit(0).cast("long").alias("df")))


def asked_terms(queries: DataFrame, stop: DataFrame | None = None, stems: bool = False) -> DataFrame:
    """(query_id, term): the words that queries (query_id, query) ask for; those of the stoplist only where a query has no others."""
    words = F.transform(T.search_terms(F.col("query")), lambda t: unmarked(F.lower(t)))
    asked = queries.select("query_id", F.explode(F.array_distinct(stemmed(words) if stems else words)).alias("term"))
    if stop is None:
        return asked
    marked = asked.join(F.broadcast(stop.select("term", F.lit(True).alias("_stop"))), "term", "left").withColumn("_stop", F.coalesce("_stop", F.lit(False)))
    plain = F.max((~F.col("_stop")).cast("int")).over(Window.partitionBy("query_id"))
    return marked.withColumn("_plain", plain).where((F.col("_plain") == 0) | ~F.col("_stop")).select("query_id", "term")


def stem_postings(chunks: DataFrame, columns: dict[str, float], queries: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The postings of the stems that queries ask for, and (docs, avg_len) of all documents, by one pass over the texts.

    A task stems each distinct word of a batch once and counts by numbers; other stems, which no
    query of these can score, make no rows.  Stems leave the number of words as it is.  Chunks of
    one id have rows of their own, which :func:`bm25` adds up if it is told of ``parts``.
    """
    asked = asked_terms(queries, stems=True).select("term").distinct().where("term <> ''").limit(BROADCAST_ROWS + 1).collect()
    if len(asked) > BROADCAST_ROWS:
        return postings(chunks, columns, id_col, True), corpus_size(chunks, columns, id_col)
    own = chunks.sparkSession.sparkContext.broadcast(sorted(r["term"] for r in asked))
    weights = list(columns.values())

    def run(batches):
        stems = pa.array(own.value, pa.string())
        place = {t: i for i, t in enumerate(own.value)}
        for batch in batches:
            n, at, code, weight = batch.num_rows, [], [], []
            for i, w in enumerate(weights):
                words = batch.column(batch.schema.names.index(f"w{i}"))
                met = words.flatten().dictionary_encode()
                found = np.array([place.get(porter(x), -1) for x in met.dictionary.to_pylist()], np.int64)[np.asarray(met.indices)]
                doc = np.repeat(np.arange(n), np.diff(np.asarray(words.offsets)))
                at.append(doc[found >= 0])
                code.append(found[found >= 0])
                weight.append(np.full(len(at[-1]), w))
            width = max(1, len(stems))
            keys, where = np.unique(np.concatenate(at) * width + np.concatenate(code), return_inverse=True)
            doc, own_code = keys // width, keys % width
            # A document without any of the stems has a row, too, as it counts for the size.
            bare = np.setdiff1d(np.arange(n), doc)
            row = pa.array(np.r_[doc, bare])
            term = pa.concat_arrays([stems.take(pa.array(own_code)), pa.nulls(len(bare), pa.string())])
            wtf, tf = (np.r_[np.bincount(where, x, len(keys)), np.zeros(len(bare))] for x in (np.concatenate(weight), None))
            first = np.r_[np.diff(doc, prepend=-1) > 0, np.ones(len(bare), bool)]
            ids, size = (batch.column(batch.schema.names.index(c)).take(row) for c in ("id", "len"))
            yield pa.RecordBatch.from_arrays([ids, size, term, pa.array(wtf), pa.array(tf.astype(np.int64)), pa.array(first)], names=["id", "len", "term", "wtf", "tf", "head"])

    sized = _sized(chunks, columns, id_col)
    rows = written(sized.mapInArrow(run, f"id {sized.schema['id'].dataType.simpleString()}, len long, term string, wtf double, tf long, head boolean"))[0]
    full = F.when(F.col("head") & (F.col("len") > 0), F.col("len"))
    return rows.where("term is not null").drop("head"), rows.agg(F.count(full).alias("docs"), F.avg(full).alias("avg_len"))


def _by_id(rows: DataFrame, parts: bool = False) -> DataFrame:
    """Rows (id, len, term, wtf): those of an id in one task, one after the other; parts of one term are added up there."""
    dealt = rows.repartition("id")
    dealt = dealt.groupBy("id", "len", "term").agg(F.sum("wtf").alias("wtf")) if parts else dealt
    return dealt.sortWithinPartitions("id")


def bm25(index: DataFrame, queries: DataFrame, k: int = 10, stop: DataFrame | None = None, size: DataFrame | None = None, stems: bool = False, allowed: DataFrame | None = None, parts: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k best of each query (query_id, query) by BM25.

    Scores are rounded to 9 digits before they are ranked; ties go to the smaller id.  The
    index is read once for the postings of the queries' terms, which are dealt by document and
    saved.  Documents are scored in blocks against blocks of QUERY_BLOCK queries: a task holds a
    block's scores and its own k best of each query, and sends on those alone.  Words of the
    stoplist are not asked for, unless a query has no others.  ``allowed`` (id) filters results;
    frequencies are those of the whole index.  An index may have a term of an id in ``parts``.
    """
    asked = saved(asked_terms(queries, stop, stems))
    hint = F.broadcast if asked.count() <= BROADCAST_ROWS else (lambda x: x)
    wanted = saved(_by_id(index.join(hint(asked.select("term").distinct()), "term", "left_semi").select("id", "len", "term", "wtf"), parts))
    total = index_size(index) if size is None else size
    df = wanted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    raw = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.select("term", F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw).alias("idf"), "avg_len")
    known = saved(asked.join(idf, "term"))
    hit = wanted if allowed is None else _by_id(wanted.join(allowed.select("id"), "id", "left_semi"))
    blocks = max(1, -(-known.select("query_id").distinct().count() // QUERY_BLOCK))
    cut = lambda i: known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else known
    scored = [_score_asked(hit, cut(i).collect(), queries.schema["query_id"].dataType, k) for i in range(blocks)]
    return top_k(reduce(DataFrame.unionByName, scored), k)


def _score_asked(hit: DataFrame, asked: list, kind, k: int) -> DataFrame:
    """(query_id, id, score) of the k best documents of each task for a block of queries; rows (id, len, term, wtf) lie by id."""
    ids, terms = list(dict.fromkeys(r["query_id"] for r in asked)), list(dict.fromkeys(r["term"] for r in asked))
    query, place = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
    rows = np.array([(place[r["term"]], query[r["query_id"]]) for r in asked], np.int64).reshape(-1, 2)
    rows, weight = rows[np.argsort(rows[:, 0], kind="stable")], np.zeros(len(terms))
    weight[[place[r["term"]] for r in asked]] = [r["idf"] for r in asked]
    own = hit.sparkSession.sparkContext.broadcast((ids, terms, np.bincount(rows[:, 0], minlength=len(terms)), rows[:, 1], weight, asked[0]["avg_len"] if asked else 1.0))
    id_type, cells = to_arrow_type(kind), SCORE_CELLS

    def run(batches):
        ids, terms, width, of, idf, mean = own.value
        start, n, values = np.cumsum(width) - width, max(1, len(ids)), pa.array(terms, pa.string())
        held: list[pa.Table] = []

        def score(rows: pa.Table, doc: np.ndarray) -> None:
            """Holds the k best of whole documents, numbered from 0 without gaps."""
            row = pc.index_in(rows["term"], value_set=values)
            fits = np.asarray(row.is_valid())
            at, code = doc[fits], np.asarray(row.drop_null().combine_chunks(), np.int64)
            wtf, size = (np.asarray(rows[c], np.float64)[fits] for c in ("wtf", "len"))
            part = idf[code] * wtf * (K1 + 1) / (wtf + K1 * (1 - B + B * size / mean))
            total, first = np.zeros((int(doc[-1]) + 1) * n), np.r_[True, doc[1:] != doc[:-1]]
            ends = np.cumsum(width[code])
            for a, b in _pieces(ends, cells):
                many = width[code[a:b]]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                cell = np.repeat(at[a:b] * n, many) + of[np.repeat(start[code[a:b]], many) + step]
                total += np.bincount(cell, np.repeat(part[a:b], many), len(total))
            total = total.reshape(-1, n)
            rounded = np.where(total > 0, np.round(total, 9), -np.inf)
            least = np.partition(rounded, len(rounded) - k, axis=0)[len(rounded) - k] if len(rounded) > k else np.full(n, -np.inf)
            i, j = np.nonzero((total > 0) & (rounded >= least))
            held.append(pa.table({"query": j.astype(np.int64), "id": rows["id"].combine_chunks().take(pa.array(np.flatnonzero(first)[i])), "score": rounded[i, j]}))
            if sum(map(len, held)) > 4 * k * n + 100_000:
                held[:] = [_best(pa.concat_tables(held), k)]

        def whole(rows: pa.Table, last: bool) -> pa.Table:
            """Scores the documents that are complete, in blocks; gives the rows of the one that is not."""
            code = np.asarray(rows["id"].combine_chunks().dictionary_encode(null_encoding="encode").indices)
            doc = np.cumsum(np.r_[False, code[1:] != code[:-1]])
            end = len(doc) if last else int(np.searchsorted(doc, doc[-1]))
            for a in range(0, int(doc[end - 1]) + 1 if end else 0, max(1, cells // n)):
                x, y = np.searchsorted(doc[:end], [a, a + max(1, cells // n)])
                score(rows.slice(x, y - x), doc[x:y] - a)
            return rows.slice(end)

        rest = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rest = whole(rows if rest is None else pa.concat_tables([rest, rows]), False)
        if rest is not None:
            whole(rest, True)
        if held:
            out = _best(pa.concat_tables(held), k)
            yield from pa.table({"query_id": pa.array(ids, id_type).take(out["query"].combine_chunks()), "id": out["id"], "score": out["score"]}).combine_chunks().to_batches()

    return hit.mapInArrow(run, f"query_id {kind.simpleString()}, id {hit.schema['id'].dataType.simpleString()}, score double")


def _pieces(ends: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows whose running sums rise by ``most`` at most, of a row at least."""
    out, a = [], 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        out.append((a, b))
        a = b
    return out


def top_k(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best rows of each query with their rank from 0; a task sends on k rows of a query at most."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of floats, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; null for the zero vector."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x / size))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of equal lists without nulls."""
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _best(table: pa.Table, k: int) -> pa.Table:
    """The k best rows (query, id, score, ..) of each query, the smaller id first of equal ones."""
    table = table.sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
    own = table["query"].to_numpy()
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return table.filter(pa.array(place < k))


def rounded(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Scores to DIGITS, then to fewer if fewer are asked for; halves of the double's product go away from zero, as in SQL engines."""
    for n in sorted({DIGITS, min(DIGITS, digits)}, reverse=True):
        y = x * 10.0**n
        x = np.trunc(y + np.copysign(0.5, y)) / 10.0**n
    return x


def _score_block(vectors: DataFrame, asked: list, kind, k: int, floor: float | None, digits: int) -> DataFrame:
    """(query_id, id, score, extra columns) of the k best vectors of each task for a block of queries."""
    names = [c for c in vectors.columns if c != "vec"]
    id_type = to_arrow_type(kind)
    least_of = np.array([r["least"] for r in asked], np.float64) if asked and "least" in asked[0] else None
    own = vectors.sparkSession.sparkContext.broadcast(([r["query_id"] for r in asked], np.array([r["qvec"] for r in asked], np.float64), least_of))

    def run(batches):
        ids, q, bound = own.value
        rows = max(64, (1 << 22) // max(1, len(q)))
        held: list[pa.Table] = []
        schema = None

        def close() -> pa.Table:
            return _best(pa.concat_tables(held), k)

        for batch in batches:
            full = batch.filter(batch.column(batch.schema.names.index("vec")).is_valid())
            schema = pa.schema([("query", pa.int64()), *[(n, full.schema.field(n).type) for n in names], ("score", pa.float64())])
            for at in range(0, full.num_rows, rows):
                part = full.slice(at, rows)
                raw = _matrix(part.column(part.schema.names.index("vec"))) @ q.T
                known = bound is not None and np.isfinite(bound).all()
                # Rounding keeps the order, so that the k-th score is rounded alone, and else what may reach it.
                least = rounded(np.partition(raw, len(raw) - k, axis=0)[len(raw) - k], digits) if len(raw) > k and not known else np.full(len(q), -np.inf)
                if floor is not None:
                    least = np.maximum(least, floor)
                if bound is not None:
                    least = np.maximum(least, bound)
                i, j = np.nonzero(raw >= least - 10.0**-digits)
                score = rounded(raw[i, j], digits)
                fits = score >= least[j]
                i, j, score = i[fits], j[fits], score[fits]
                at_row = pa.array(i)
                held.append(pa.Table.from_arrays([pa.array(j.astype(np.int64)), *[part.column(part.schema.names.index(n)).take(at_row) for n in names], pa.array(score)], schema=schema))
                if sum(len(t) for t in held) > 4 * k * len(q) + 100_000:
                    held[:] = [close()]
        if held:
            out = close()
            yield from pa.Table.from_arrays([pa.array(ids, id_type).take(out["query"]), *out.columns[1:]], names=["query_id", *out.column_names[1:]]).combine_chunks().to_batches()

    columns = ", ".join(f"{n} {vectors.schema[n].dataType.simpleString()}" for n in names)
    return vectors.mapInArrow(run, f"query_id {kind.simpleString()}, {columns}, score double")


def scored_vectors(vectors: DataFrame, queries: DataFrame, k: int, floor: float | None = None, digits: int = DIGITS) -> DataFrame:
    """(query_id, id, score, further columns of vectors): a superset of the k best of each query.

    Scores are rounded to ``digits`` before any are left out, so that rows that are equal by then
    are told apart by id alone.
    Queries (query_id, qvec [, least]) may bring a score that their k best are known to reach.
    The queries are a stated set, taken in blocks of QUERY_BLOCK; a block is a pass over the
    vectors, in which each task keeps its own k best of each query.
    """
    small = queries.select("query_id", "qvec", *[c for c in queries.columns if c == "least"]).where("qvec is not null")
    kind = queries.schema["query_id"].dataType
    n = small.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    cut = lambda i: small.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else small
    parts = [_score_block(vectors, cut(i).collect(), kind, k, floor, digits) for i in range(blocks)] if n else []
    return reduce(DataFrame.unionByName, parts) if parts else vectors.drop("vec").crossJoin(queries.select("query_id").limit(0)).select("query_id", *[c for c in vectors.columns if c != "vec"], F.lit(0.0).alias("score"))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, prefilter: bool = True, floor: float | None = None, digits: int = DIGITS) -> DataFrame:
    """(query_id, id, score, rank) of vectors (id, vec, ...) for queries (query_id, qvec), by cosine of unit vectors.

    ``prefilter=False`` filters after 4k candidates and may return fewer than k.  Null vectors
    are in no result.  Rows are ranked by scores of ``digits``, then by id.
    """
    if where is None or prefilter:
        rows = (vectors if where is None else vectors.where(where)).select("id", "vec")
        return top_k(scored_vectors(rows, queries, k, floor, digits), k).select("query_id", "id", "score", "rank")
    marked = vectors.select("id", "vec", F.coalesce(where, F.lit(False)).alias("fits"))
    near = top_k(scored_vectors(marked, queries, 4 * k, floor, digits), 4 * k).drop("rank").where("fits")
    return top_k(near, k).select("query_id", "id", "score", "rank")


def rrf(*arms: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, fused) of ranked arms (query_id, id, rank): the sum of 1 / (k + rank + 1)."""
    rows = reduce(DataFrame.unionAll, [a.select("query_id", "id", "rank") for a in arms])
    return rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank") + 1)), 9).alias("fused"))


def rerank(fused: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 10, intent: str | None = None) -> DataFrame:
    """(query_id, id, fused, score, rank): word overlap in text and title, and the fusion rank as a prior."""
    near = saved(fused)
    wanted = near.select("id").distinct()
    wanted = F.broadcast(wanted) if near.count() <= BROADCAST_ROWS else wanted
    body = chunks.join(wanted, "id", "left_semi").select("id", T.terms(F.col("text")).alias("body"), T.terms(F.concat_ws(" ", "title", "section")).alias("head"))
    rows = near.join(body, "id").join(queries.select("query_id", T.terms(F.col("query")).alias("q")), "query_id")
    share = lambda a, b: F.size(F.array_intersect(a, b)) / (F.size(a) + 1e-6)
    wish = T.terms(F.lit(intent)) if intent else None
    score = 0.55 * share(F.col("q"), F.col("body")) + 0.20 * share(F.col("q"), F.col("head"))
    if wish is not None:
        score = score + 0.15 * share(wish, F.col("body"))
    score = score + 0.30 * (1 - 1 / (1 + 50 * F.col("fused")))
    scored = rows.withColumn("score", F.floor(F.least(F.lit(1.0), score) * 10000 + 0.5) / 10000)
    return top_k(scored.select("query_id", "id", "fused", "score"), k)


def squash(scores: DataFrame) -> DataFrame:
    """Cross-encoder scores to 0..1: by the logistic function if any of a query's scores is outside."""
    outside = F.max(((F.col("score") < 0) | (F.col("score") > 1)).cast("int")).over(Window.partitionBy("query_id"))
    return scores.withColumn("score", F.when(outside == 1, 1 / (1 + F.exp(-F.col("score")))).otherwise(F.col("score")))


def cross_rerank(scores: DataFrame, chunks: DataFrame, k: int = 10, intent: str | None = None) -> DataFrame:
    """(query_id, id, score, rank) of cross-encoder scores (query_id, id, score, fused), squashed if need be.

    A passage without a score keeps its fusion score.  An intent adds a tenth of the share of
    its words that text, title and section have.
    """
    rows = squash(scores).withColumn("score", F.coalesce("score", "fused"))
    if intent:
        wish = T.terms(F.lit(intent))
        share = F.size(F.array_intersect(wish, T.terms(F.concat_ws(" ", "text", "title", "section")))) / (F.size(wish) + 1e-6)
        rows = rows.join(chunks.select("id", share.alias("_share")), "id", "left").withColumn("score", F.col("score") + 0.10 * F.coalesce("_share", F.lit(0.0)))
    rounded = F.floor(F.least(F.lit(1.0), F.col("score")) * 10000 + 0.5) / 10000
    return top_k(rows.select("query_id", "id", rounded.alias("score")), k)


def hybrid_search(chunks: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = 10, shortlist: int = 64, excluded: DataFrame | None = None, low: float = 0.35, stop: bool = True) -> DataFrame:
    """(query_id, id, fused, score, rank, confidence, low_confidence): sparse and dense arms, fused, filtered, reranked."""
    columns = {"text": 1.0, "title": 4.0, "section": 2.0}
    index = build_index(chunks, columns, "id")
    size = saved(index_size(index))
    words = saved(stoplist(index, size=size)) if stop else None
    arms = [bm25(index, queries, shortlist, words, size)]
    if vectors is not None and query_vectors is not None:
        arms.append(vector_search(vectors, query_vectors, shortlist))
    fused = rrf(*arms)
    if excluded is not None:
        fused = fused.join(excluded.select("id"), "id", "left_anti")
    ranked = rerank(top_k(fused, shortlist, "fused").drop("rank"), chunks, queries, k)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("confidence", best).withColumn("low_confidence", best < low)


def library_search(chunks: DataFrame, queries: DataFrame, collection: str | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = 8, shortlist: int = 64) -> DataFrame:
    """(query_id, id, score, rank, dense_used): words first; a query is fused with its dense hits only if it has any.

    ``collection`` keeps chunks of one source_type.  A query's confidence is the score at rank 0;
    a query without a passage has no row, which is its low confidence.
    """
    rows = chunks if collection is None else chunks.where(F.col("source_type") == collection)
    columns = {"text": 1.0, "title": 4.0, "section": 2.0}
    index = build_index(rows, columns, "id")
    size = saved(index_size(index))
    sparse = bm25(index, queries, shortlist, saved(stoplist(index, size=size)), size)
    arms, used = [sparse], rows.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, dense_used boolean")
    if vectors is not None and query_vectors is not None:
        dense = saved(vector_search(vectors.join(rows.select("id"), "id", "left_semi"), query_vectors, shortlist))
        arms.append(dense)
        used = dense.select("query_id", F.lit(True).alias("dense_used")).distinct()
    best = top_k(rrf(*arms), shortlist, "fused").drop("rank").join(used, "query_id", "left")
    # A query of words alone has no fusion score for a prior.
    prior = best.select("query_id", "id", F.when(F.col("dense_used"), F.col("fused")).otherwise(0.0).alias("fused"))
    ranked = rerank(prior, rows, queries, k).select("query_id", "id", "score", "rank")
    return ranked.join(used, "query_id", "left").withColumn("dense_used", F.coalesce("dense_used", F.lit(False)))


def slice_rerank(slices: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): the slices (query_id, id) that a lexical search gave each query, by cosine to four digits; 0 without a vector."""
    both = slices.select("query_id", "id").join(vectors.select("id", "vec"), "id", "left").join(query_vectors.select("query_id", "qvec"), "query_id")
    score = F.floor(F.coalesce(dot(F.col("vec"), F.col("qvec")), F.lit(0.0)) * 10000 + 0.5) / 10000
    return top_k(both.select("query_id", "id", score.alias("score")), k)
