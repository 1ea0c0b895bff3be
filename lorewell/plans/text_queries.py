"""Queries of the text functions, ingest and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import dedupe, ingest
from lorewell.plans.registry import Registry, table

R = Registry()
_quote = lambda s: s.replace("'", "''")
NORM = f"replace(lower(trim(regexp_replace(translate(coalesce(text, ''), '{_quote(T.FOLD_FROM)}', '{_quote(T.FOLD_TO)}'), '[\\s\\x0B]+', ' ', 'g'))), 'ß', 'ss')"
HASH = f"substr(sha1({NORM}), 1, 20)"


@R.query(f"""
WITH h AS (SELECT doc_id, {HASH} AS text_hash FROM documents),
o AS (SELECT text_hash, min(doc_id) AS owner FROM h GROUP BY text_hash)
SELECT doc_id, text_hash, owner, doc_id <> owner AS is_dupe FROM h JOIN o USING (text_hash)""")
def exact_duplicate_owners(spark, d):
    return dedupe.exact_owners(table(spark, d, "documents"))


@R.query(f"""
WITH h AS (SELECT doc_id, {HASH} AS h FROM documents), o AS (SELECT h, min(doc_id) AS owner FROM h GROUP BY h)
SELECT 'exact' AS kind, count(*) AS n FROM h JOIN o USING (h) WHERE doc_id <> owner HAVING count(*) > 0""")
def dupe_counts(spark, d):
    own = dedupe.exact_owners(table(spark, d, "documents")).where("is_dupe")
    return dedupe.dupe_stats(own.select(F.lit("exact").alias("kind")))


_MARK = r"(?i)(<\|[^|>]{0,40}\|>|<\s*/?\s*(s|im_start|im_end|system|user|assistant|tool)\s*>|\[/?\s*(INST|SYS|/?s)\s*\]|#{2,}\s*(system|user|assistant|human|ai)\b)"


@R.query(rf"""
WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{{80}}-\x{{9f}}]', ' ', 'g'),
  '{_MARK}', ' ', 'g') AS s FROM conversations),
b AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(s, '[ \t\f\x0b]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'),
  ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS s FROM a)
SELECT conv_id, turn, CASE WHEN length(s) > 200 THEN rtrim(substr(s, 1, 200)) || '…' ELSE s END AS cleaned FROM b""")
def sanitized_turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean(F.col("text"), 200).alias("cleaned"))


@R.query(f"""
SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens, substr(sha1(source || chr(0) || lang || chr(0) || text), 1, 20) AS chunk_id,
  {HASH} AS text_hash FROM documents""")
def chunk_identity(spark, d):
    c = F.col
    return table(spark, d, "documents").select("doc_id", T.est_tokens(c("text")).alias("tokens"), T.chunk_id(c("source"), c("lang"), c("text")).alias("chunk_id"), T.text_hash(c("text")).alias("text_hash"))


_STEM = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND regexp_matches(w, '[sxzo]es$') THEN left(w, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"


@R.query(f"""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
SELECT doc_id, count(*) FILTER (length(w) > 2) AS n_terms, count(DISTINCT {_STEM}) AS n_stems FROM w GROUP BY doc_id""")
def term_sets(spark, d):
    words = table(spark, d, "documents").select("doc_id", T.ascii_terms(F.col("text")).alias("w")).where(F.size("w") > 0)
    stems = F.size(F.array_distinct(F.transform("w", T.stem))).cast("long")
    return words.select("doc_id", F.size(F.filter("w", lambda w: F.char_length(w) > 2)).cast("long").alias("n_terms"), stems.alias("n_stems"))


_ZONE = {k: "(" + ", ".join(f"'{_quote(x)}'" for x in v) + ")" for k, v in T.HEADINGS.items()}
_re = lambda p: "'" + _quote(p) + "'"


@R.query(rf"""
WITH s AS (SELECT doc_id, text, lower(CASE doc_id % 7 WHEN 0 THEN 'Part > 3.2 References' WHEN 1 THEN 'Book > Contents' WHEN 2 THEN 'Copyright'
  ELSE 'History > Founding' END) AS section FROM documents),
h AS (SELECT doc_id, coalesce(text, '') AS text, trim(regexp_replace(regexp_replace(trim(string_split(section, '>')[-1]), '^[\s0-9.:—-]+', ''),
  '[^a-z'' ]', '', 'g')) AS head FROM s),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM h),
c AS (SELECT doc_id, count(*) AS n, sum(length(x)) AS chars,
    count(*) FILTER (regexp_matches(x, {_re(T.YEAR)}) AND (regexp_matches(x, {_re(T.CITED)}) OR length(x) - length(replace(x, ',', '')) >= 2)) AS cited,
    count(*) FILTER (regexp_matches(x, {_re(T.LEADER)})) AS leaders, count(*) FILTER (regexp_matches(x, {_re(T.PAGE_NUMBER)})) AS pages,
    count(*) FILTER (regexp_matches(x, {_re(T.INDEX_LINE)})) AS idx, count(*) FILTER (regexp_matches(x, {_re(T.CODE)})) AS code,
    count(*) FILTER (regexp_matches(x, {_re(T.SENTENCE_END)})) AS prose
  FROM l WHERE trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> '' GROUP BY doc_id)
SELECT doc_id, CASE WHEN head IN {_ZONE['references']} THEN 'references' WHEN head IN {_ZONE['toc']} THEN 'toc'
  WHEN head IN {_ZONE['index']} THEN 'index' WHEN head IN {_ZONE['boilerplate']} THEN 'boilerplate'
  WHEN coalesce(n, 0) < 5 AND len(regexp_extract_all(text, {_re(T.IMPRINT)})) >= 2 THEN 'boilerplate' WHEN coalesce(n, 0) < 5 THEN 'body'
  WHEN n >= 6 AND cited >= 0.4 * n THEN 'references' WHEN leaders >= 0.3 * n THEN 'toc' WHEN n >= 8 AND pages >= 0.6 * n AND chars < 60 * n THEN 'toc'
  WHEN n >= 8 AND idx >= 0.5 * n THEN 'index' WHEN len(regexp_extract_all(text, {_re(T.IMPRINT)})) >= 2 AND length(text) < 2000 THEN 'boilerplate'
  WHEN code >= 0.4 * n AND code > prose THEN 'code' ELSE 'body' END AS zone
FROM h LEFT JOIN c USING (doc_id)""")
def zones(spark, d):
    section = F.expr("CASE doc_id % 7 WHEN 0 THEN 'Part > 3.2 References' WHEN 1 THEN 'Book > Contents' WHEN 2 THEN 'Copyright' ELSE 'History > Founding' END")
    return table(spark, d, "documents").select("doc_id", T.zone(section, F.col("text")).alias("zone"))


_NOTICES = ["", "Copyright 2015 by Acme Press. All rights reserved", "SPDX-License-Identifier: gplv3", "see creativecommons.org/licenses/by-nc/3.0 ", "creativecommons.org/publicdomain/mark", "(c) 1999-2004 Jane Doe, licensed under MIT", "in the PUBLIC domain", "SPDX-License-Identifier: Own-1"]
_HOLDER = r"""'(?i)(?:©|\(c\)|copyright)\s*(?:©\s*)?(?:(\d{4})(?:\s*[-–]\s*\d{4})?)?\s*(?:by\s+)?([A-Z][A-Za-z0-9.,&''’\- ]{2,70})'"""
_FOUND = ["", "Acme Press|all-rights-reserved", "|GPL-3.0-only", "|CC-BY-NC-4.0", "|public-domain", "Jane Doe|", "|public-domain", "|unknown"]


@R.query(f"""
WITH t AS (SELECT doc_id, text, doc_id % 8 + 1 AS k FROM documents),
c AS (SELECT doc_id, k, regexp_extract(text, 'SPDX-License-Identifier:\\s*([A-Za-z0-9.\\-+]+)', 1) AS tag, regexp_extract(text,
  '(?i)creativecommons\\.org/licenses/(by[a-z-]*)/', 1) AS cc,
  regexp_matches(substr(text, 1, 20000), '(?i)\\bpublic domain\\b') AS pd, regexp_matches(substr(text, 1, 20000), '(?i)\\ball rights reserved\\b') AS arr FROM t),
h AS (SELECT doc_id AS id, trim(regexp_extract(substr({_NOTICES}[k] || chr(10) || text, 1, 20000), {_HOLDER}, 2), ' .,-') AS h FROM t),
o AS (SELECT id, trim(regexp_replace(h, '(?i)(?:\\.\\s|\\s+(?:all rights|is\\s+licensed|licensed|under|released|published|\\d{{4}})).*$', ''), ' .,-') AS holder FROM h),
p AS (SELECT doc_id, {[x.split("|")[-1] for x in _FOUND]}[k] AS planted, tag, cc, pd, arr, k, holder FROM c JOIN o ON id = doc_id)
SELECT doc_id, CASE WHEN k IN (3, 8) THEN planted WHEN tag <> '' THEN tag WHEN k IN (4, 5) THEN planted
  WHEN cc <> '' THEN 'CC-' || upper(cc) || '-4.0' WHEN pd OR k = 7 THEN 'public-domain' WHEN arr OR k = 2 THEN 'all-rights-reserved' END AS licence,
  CASE WHEN length(holder) >= 2 THEN holder END AS holder FROM p""")
def licences(spark, d):
    """Licences of the documents behind a notice each, and the holders that they name."""
    notice = F.array(*map(F.lit, _NOTICES))[(F.col("doc_id") % 8).cast("int")]
    docs = table(spark, d, "documents").select("doc_id", T.detect_licence(F.concat(notice, F.lit("\n"), F.col("text"))).alias("f"))
    return docs.select("doc_id", "f.licence", "f.holder")


@R.query("""
WITH q AS (SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(q, '^(how do|how to|how can|how should|steps to)') THEN 'how'
  WHEN contains(q, 'what if') OR q LIKE 'what would happen%' THEN 'what_if'
  WHEN regexp_matches(q, '^(what causes|what could cause|what might cause|why might|why would|what could explain|what''s causing)') OR contains(q,
    'causes of') OR contains(q, 'differential') THEN 'why_diag'
  WHEN regexp_matches(q, '^(why|how does|how is)') THEN 'why_mech' WHEN q LIKE 'who%' THEN 'who' WHEN q LIKE 'where%' THEN 'where'
  WHEN regexp_matches(q, 'what kind|what type|is a kind of') THEN 'taxonomy' WHEN q LIKE 'which%' THEN 'which' ELSE 'what' END AS intent FROM q""")
def intents(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


def _speech_sql() -> str:
    cues = lambda value: " ".join(f"WHEN regexp_matches(q, {_re(p)}) THEN {value(a, c)}" for a, c, p in T.SPEECH_ACTS)
    rest = lambda o, f, a: f"WHEN NOT asks AND regexp_matches(q, {_re(T.NARRATOR)}) AND regexp_matches(q, {_re(T.NARRATION)}) THEN {o} WHEN asks THEN {f} ELSE {a} END"
    return rf"""
WITH q AS (SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS q FROM conversations),
a AS (SELECT *, q LIKE '%?' OR regexp_matches(q, {_re(T.QUESTION)}) AS asks FROM q)
SELECT conv_id, turn, CASE WHEN q = '' THEN 'ambiguous' {cues(lambda a, c: f"'{a}'")} {rest("'observation'", "'factual'", "'ambiguous'")} AS speech_act,
  (CASE WHEN q = '' THEN 0.0 {cues(lambda a, c: c)} {rest(0.7, 0.6, 0.3)})::DOUBLE AS confidence FROM a"""


@R.query(_speech_sql())
def speech_acts(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.speech_act(F.col("text")).alias("s"))
    return rows.select("conv_id", "turn", F.col("s.act").alias("speech_act"), "s.confidence")


@R.query(f"""
WITH w AS (SELECT DISTINCT h, list_filter(string_split(t, ' '), lambda x: x <> '') AS w, min_id
  FROM (SELECT {HASH} AS h, {NORM} AS t, min(doc_id) OVER (PARTITION BY {HASH}) AS min_id FROM documents) WHERE t <> ''),
s AS (SELECT DISTINCT min_id AS id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id)
SELECT id AS doc_id, n AS n_shingles FROM n""")
def shingle_counts(spark, d):
    grams = dedupe.shingle_rows(dedupe.distinct_texts(table(spark, d, "documents")))
    return grams.groupBy("text_hash", F.col("id").alias("doc_id")).agg(F.count("*").alias("n_shingles")).select("doc_id", "n_shingles")


@R.query(f"""
WITH t AS (SELECT doc_id AS id, {NORM} AS t FROM documents WHERE {NORM} <> ''),
f AS (SELECT t, min(id) AS first FROM t GROUP BY t),
w AS (SELECT first AS id, string_split(t, ' ') AS w FROM f),
s AS (SELECT id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS first, b.id AS later, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
p AS (SELECT first, later, round(c / (x.n + y.n - c), 4) AS similarity FROM c JOIN n x ON x.id = first JOIN n y ON y.id = later
  UNION ALL SELECT first, id, 1.0 FROM t JOIN f USING (t) WHERE id <> first)
SELECT first, later, similarity FROM p WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY later ORDER BY first) = 1""")
def near_duplicates(spark, d):
    """The first text that each near copy is one of, by exact similarities."""
    return dedupe.near_owners(table(spark, d, "documents"), 0.8)


@R.query("SELECT coalesce(source, '?') AS source_type, count(*) AS n FROM documents GROUP BY 1")
def stats_by_source(spark, d):
    return ingest.stats_by_source(table(spark, d, "documents"), "source")


_LISTING = "SELECT doc_id AS path, sha1(text) AS content_hash, doc_id * 1.0 AS mtime FROM documents WHERE doc_id % 11 <> 3"
_MANIFEST = "SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha1(text) END AS content_hash, doc_id * 1.0 + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS mtime, CASE WHEN doc_id % 13 = 0 THEN 'missing_dep' ELSE 'ok' END AS status FROM documents WHERE doc_id % 7 <> 2"


@R.query(f"""
WITH l AS ({_LISTING}), m AS ({_MANIFEST})
SELECT coalesce(l.path, m.path) AS path, CASE WHEN l.path IS NULL THEN 'delete' WHEN m.path IS NULL THEN 'insert' WHEN m.status = 'missing_dep' THEN 'retry'
  WHEN abs(l.mtime - m.mtime) < 1e-6 THEN 'skip' WHEN l.content_hash = m.content_hash THEN 'refresh' ELSE 'replace' END AS action
FROM l FULL JOIN m ON l.path = m.path""")
def incremental_actions(spark, d):
    docs = table(spark, d, "documents")
    sha, at = F.sha1("text"), F.col("doc_id") * 1.0
    listing = docs.where("doc_id % 11 <> 3").select(F.col("doc_id").alias("path"), sha.alias("content_hash"), at.alias("mtime"))
    manifest = docs.where("doc_id % 7 <> 2").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(sha).alias("content_hash"), (at + F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1)).alias("mtime"), F.when(F.col("doc_id") % 13 == 0, "missing_dep").otherwise("ok").alias("status"))
    return ingest.incremental_actions(listing, manifest)


@R.query(f"""
WITH h AS (SELECT doc_id, source, {HASH} AS h FROM documents), o AS (SELECT h, min(doc_id) AS owner FROM h GROUP BY h),
s AS (SELECT h.*, owner <> doc_id AS dupe, doc_id % 4 = 0 AS distilled FROM h JOIN o USING (h))
SELECT source, count(*) AS chunks, count(*) FILTER (distilled) AS distilled, count(*) FILTER (dupe) AS dupes,
  count(*) FILTER (NOT distilled AND NOT dupe) AS pending FROM s GROUP BY source""")
def source_progress(spark, d):
    docs = table(spark, d, "documents")
    dupes = dedupe.exact_owners(docs).where("is_dupe").select("doc_id")
    return ingest.source_progress(docs, docs.where("doc_id % 4 = 0").select("doc_id"), dupes, "source")


@R.query("""
WITH p AS (SELECT source, doc_id, n_chars FROM documents WHERE doc_id % 4 <> 0)
SELECT source, count(DISTINCT doc_id) AS waiting, max(n_chars) AS newest FROM p GROUP BY source ORDER BY newest DESC, source LIMIT 5""")
def pending_sources(spark, d):
    docs = table(spark, d, "documents")
    return ingest.pending_sources(docs, docs.where("doc_id % 4 = 0").select("doc_id"), "source", "n_chars", 5)


@R.query("""
SELECT CASE WHEN url LIKE '%/en/%' THEN 'english' WHEN regexp_matches(url, '^https?://[^/]*blog[^/]*/') THEN 'blogs'
  ELSE 'library' END AS collection, count(*) AS n FROM pages GROUP BY 1""")
def collections(spark, d):
    rules = {"en": "english", "*://*blog*/*": "blogs"}
    return table(spark, d, "pages").groupBy(ingest.collection_for(F.col("url"), rules, "library").alias("collection")).agg(F.count("*").alias("n"))


@R.query()
def page_chunks(spark, d):
    """HTML to sections to chunks with ids; tests hold its parts against goldens."""
    from lorewell.sources.html import html_blocks

    blocks = html_blocks(table(spark, d, "pages"), "page_id", "html", "url")
    return ingest.chunk_documents(blocks, "page_id")


@R.query("SELECT doc_id, text, lang FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'newest', lang FROM documents WHERE doc_id % 3 = 0")
def upserted_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", F.lit(0).alias("at"))
    new = docs.where("doc_id % 3 = 0")
    twice = new.withColumns({"text": F.lit("newest"), "at": F.lit(2)}).unionByName(new.withColumns({"text": F.lit("new"), "at": F.lit(1)}))
    return ingest.upsert(docs, twice, "doc_id", "at").drop("at")


@R.query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id NOT IN (SELECT doc_id FROM documents)")
def kept_vectors(spark, d):
    """Vectors after their chunks were replaced: a replaced row loses its old one."""
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    return ingest.kept_vectors(vectors, table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("vec_id")), "vec_id")


_REGIMES = {"src1": "fictional", "*src?5": "historical", "SRC2": "interpretive", "src3": "invented"}


@R.query(r"""WITH p AS (SELECT doc_id, '/lib/' || source || '\Deep/' || source || '5' AS path, source FROM documents)
SELECT doc_id, CASE WHEN source = 'src1' THEN 'fictional' WHEN regexp_matches(lower(path), '^.*src.5$') THEN 'historical'
  WHEN source = 'src2' THEN 'interpretive' END AS regime FROM p""")
def path_regimes(spark, d):
    path = F.concat(F.lit("/lib/"), "source", F.lit("\\Deep/"), "source", F.lit("5"))
    return table(spark, d, "documents").select("doc_id", T.regime_for_path(path, _REGIMES).alias("regime"))


@R.query("SELECT doc_id, lang FROM documents WHERE source <> 'src3'")
def deleted_by_path(spark, d):
    docs = table(spark, d, "documents")
    gone = spark.createDataFrame([("src3",)], "source string")
    return ingest.delete_by_path(docs, gone, "source").select("doc_id", "lang")
