"""The ``opN_*`` queries: each applies its operator to a whole table and returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary file that packing counts tokens with, by name.
VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.jaccard_join import shingle_components

    return shingle_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.quality_model import classify_quality

    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.lm_scoring import score_language_model

    out = score_language_model(_table(spark, sf_dir, "documents"))
    # Sums of doubles differ in their last digits by the order of the words.
    return out.withColumn("log_score", F.round("log_score", 4)).withColumn("mean_log_score", F.round("mean_log_score", 6))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.line_dedup import drop_repeated_lines

    out = drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.packing import pack_documents

    out = pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.language_id import identify_language

    return identify_language(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.decontaminate import mark_contaminated

    return mark_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short_items=True)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.quality_rules import quality_report

    return quality_report(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.pii import find_pii

    out = find_pii(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_base", "n_spans")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.hard_negatives import hard_negatives

    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(_table(spark, sf_dir, "embeddings"), anchor=F.expr("vec_id % 100 = 0"), label=label)


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.repeats import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.merkle import manifest

    lowered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    return manifest(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": lowered})


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_WORD = r"[^\x20\x09-\x0D]+"


def _op1_sql() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
q AS (SELECT node, min(reached) AS component FROM r GROUP BY node),
i AS (SELECT min(doc_id) AS class_id, s FROM (SELECT doc_id, list_sort(list(s)) AS s FROM s GROUP BY doc_id) GROUP BY s),
k AS (SELECT doc_id, class_id FROM (SELECT doc_id, list_sort(list(s)) AS s FROM s GROUP BY doc_id) JOIN i USING (s))
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(class_id, d.doc_id) AS class_id, coalesce(component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN q ON q.node = d.doc_id"""


def _op3_sql() -> str:
    from lorewell.llm.lm_scoring import BACKOFF

    others = lambda gram: f"count(*) OVER (PARTITION BY {gram}) - count(*) OVER (PARTITION BY r, {gram})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
p AS (SELECT r, len(w) AS n, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT r, n, i, w[i] AS g1, w[i - 1] || ' ' || w[i] AS g2, w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] AS g3 FROM p),
c AS (SELECT r, n, i, {others("g1")} AS c1, CASE WHEN i > 1 THEN {others("g2")} ELSE 0 END AS c2, CASE WHEN i > 2 THEN {others("g3")} ELSE 0 END AS c3 FROM g),
x AS (
  SELECT *, greatest(1, (SELECT count(*) FROM p) - n) AS rest, greatest(1, lag(c1) OVER (PARTITION BY r ORDER BY i)) AS b1,
    greatest(1, lag(c2) OVER (PARTITION BY r ORDER BY i)) AS b2, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS k
  FROM c),
v AS (
  SELECT r, k, CASE k WHEN 3 THEN ln(c3 / b2) WHEN 2 THEN ln(c2 / b1) WHEN 1 THEN ln(c1 / rest) ELSE ln(0.5 / rest) END
    + (least(3, i) - greatest(k, 1) + (k = 0)::INT) * ln({BACKOFF}) AS value FROM x),
s AS (
  SELECT r, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = 0) AS n0, sum(value) AS value
  FROM v GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n1, 0) AS n_order_1, coalesce(n2, 0) AS n_order_2, coalesce(n3, 0) AS n_order_3, coalesce(n0, 0) AS n_unseen,
  round(coalesce(value, 0), 4) AS log_score, round(value / len(w), 6) AS mean_log_score
FROM d LEFT JOIN s USING (r)"""


def _op4_sql() -> str:
    return f"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (SELECT k.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""


def _op5_sql() -> str:
    from lorewell.llm.url_filter import BLOCK_GLOBS, UNRESERVED

    # The contract's rules, longest first.
    ruled = [("block", "example.net", "/de/8"), ("allow", "example.com", "/en/7"), ("block", "com", "/en/"), ("allow", "net", "/de/"), ("block", "org", "/es/")]
    fits = lambda h, p: f"(('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}'))"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ruled)
    says = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ruled)
    halves = [g.split("|") for g in BLOCK_GLOBS]
    globs = " OR ".join(f"(('.' || own_host) GLOB '{h}' AND own_path GLOB '{p}')" for h, p in halves)
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    code = "chr(('0x' || substr(x, 1, 2))::INT)"
    plain = f"CASE WHEN NOT regexp_matches(x, '^[0-9a-f]{{2}}') THEN '%' || x WHEN contains('{UNRESERVED}', {lower(code)}) THEN {lower(code)} || substr(x, 3) ELSE '%' || x END"
    return f"""
WITH u AS (
  SELECT page_id, strpos(url, '://') AS place, url FROM pages),
p AS (
  SELECT page_id, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS rest FROM u),
h AS (
  SELECT page_id, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
s AS (SELECT *, string_split({lower("path")}, '%') AS pieces FROM h),
c AS (
  SELECT page_id, host, path,
    {lower(r"regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')")} AS own_host,
    regexp_replace(pieces[1] || array_to_string(list_transform(pieces[2:], lambda x: {plain}), ''), '/+', '/', 'g') AS own_path
  FROM s)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {says} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict
FROM c"""


def _op9_sql() -> str:
    from lorewell.llm.quality_rules import CLOSING, FURNITURE, SYMBOLS, Rules

    r = Rules()
    quote = lambda b: b.decode().replace("'", "''")
    furniture = " OR ".join(f"contains(low, '{quote(p)}')" for p in FURNITURE)
    closing = "".join(f"\\{c}" if c.isascii() else c for c in CLOSING).replace("'", "''")
    symbols = "".join(f"\\{c}" for c in SYMBOLS.decode())
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM x),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM c, range(5) AS t(j) WHERE n > 1 GROUP BY doc_id),
l AS (
  SELECT doc_id, line, pos, len(regexp_extract_all(line, '{_WORD}')) AS n,
    length(array_to_string(regexp_extract_all(line, '{_WORD}'), '')) AS chars,
    length(regexp_replace(line, '[^{symbols}]', '', 'g')) AS sym,
    length(regexp_replace(line, '[^A-Z]', '', 'g')) AS cap,
    length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS let,
    translate(line, '{_UPPER}', '{_LOWER}') AS low,
    regexp_matches(line, '[{closing}][\x20\x09-\x0D]*$') AS closed
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM w)),
f AS (
  SELECT *, n > 0 AND (sym > {r.symbols_per_word} * n OR (let >= {r.capital_letters} AND cap > {r.capital_share} * let)
    OR (n < {r.unclosed_words} AND NOT closed) OR (n <= {r.furniture_words} AND ({furniture}))) AS failed FROM l),
s AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(*) AS n_lines,
    count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(chars) FILTER (NOT failed), 0)::BIGINT AS kept_chars,
    sum(n)::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars, sum(sym)::BIGINT AS n_symbols
  FROM f GROUP BY doc_id),
b AS (
  SELECT s.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < {r.min_words} OR 100 * coalesce(n_repeat_words, 0) > {r.max_repeat_percent} * n_words AS base_failed
  FROM s LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND kept_chars >= {r.kept_share} * word_chars AS kept, n_lines, n_failed_lines, kept_chars
FROM b"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = "list_reduce([xor(c, ascii(x)), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: " + bit + ")"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: {byte.replace('ascii(x)', 'x')}), 4294967295)"


_OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


_OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, doc_id, unnest(range(1, length(x) // 2 + 1)) AS i, x FROM d),
w AS (SELECT r, doc_id, i, substr(x, 2 * i - 1, 2) AS byte, CASE WHEN 2 * i + 98 <= length(x) THEN substr(x, 2 * i - 1, 100) END AS s FROM p),
o AS (SELECT s, min(doc_id) AS owner FROM w WHERE s IS NOT NULL GROUP BY s),
f AS (
  SELECT r, i, byte, coalesce(bool_or(owner < doc_id) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
  FROM w LEFT JOIN o USING (s)),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM f),
k AS (
  SELECT r, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
    coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM g GROUP BY r)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""


def _op13_sql() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    return f"""
WITH RECURSIVE t AS (
  SELECT *, CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS changed FROM documents),
d AS (SELECT doc_id, lang, {leaf("text")} AS leaf, {leaf("changed")} AS tampered FROM t),
a AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n, leaf, tampered FROM d),
u AS (
  SELECT 0 AS level, g, pos, n, leaf AS node FROM a
  UNION ALL
  SELECT level + 1, g, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, g, pos // 8, n),
s AS (SELECT g, node AS subroot, level AS levels FROM u WHERE n = 1),
v AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, subroot AS node FROM s
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM v WHERE n > 1 GROUP BY level, pos // 8, n),
w AS (
  SELECT 0 AS tree, level, g, pos, list(node) OVER run AS nodes FROM u WHERE n > 1 WINDOW run AS (PARTITION BY level, g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  UNION ALL
  SELECT 1, level, '', pos, list(node) OVER run FROM v WHERE n > 1 WINDOW run AS (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT tree, level, g, pos, array_to_string(nodes[1:pos % 8], '') AS l, array_to_string(nodes[pos % 8 + 2:], '') AS r FROM w),
h AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS place, subroot, levels FROM s),
f AS (
  SELECT a.g, a.pos AS leaf_pos, 0 AS step, levels, place, tampered AS node, '' AS proof FROM a JOIN h USING (g)
  UNION ALL
  SELECT f.g, leaf_pos, step + 1, levels, place, sha256(l || node || r), proof || l || r
  FROM f JOIN x ON x.tree = (step >= levels)::INT AND x.level = CASE WHEN step < levels THEN step ELSE step - levels END
    AND x.g = CASE WHEN step < levels THEN f.g ELSE '' END
    AND x.pos = CASE WHEN step < levels THEN leaf_pos // (8 ** step)::BIGINT ELSE place // (8 ** (step - levels))::BIGINT END),
e AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY g, leaf_pos ORDER BY step DESC) = 1),
r AS (SELECT node AS root FROM v WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, e.node AS folded_root, e.node = root AS verified
FROM a JOIN h USING (g) JOIN e ON e.g = a.g AND e.leaf_pos = a.pos CROSS JOIN r"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_quality_classifier, op3_lm_scoring, op4_line_dedup, op5_url_filter, op6_packing, op7_language_id, op8_decontamination, op9_quality_rules, op10_pii, op11_hard_negatives, op12_suffix_array_dedup, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": _op1_sql(), "op3_lm_scoring": _op3_sql(), "op4_line_dedup": _op4_sql(), "op5_url_filter": _op5_sql(), "op9_quality_rules": _op9_sql(), "op11_hard_negatives": _OP11_SQL, "op12_suffix_array_dedup": _OP12_SQL, "op13_merkle_manifest": _op13_sql()}
