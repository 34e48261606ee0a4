"""The numbered queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embed, gnat, langid, linededup, lm, maxsketch, minhash, packing, segments, suffixdedup, tokencounts, warc
from .common import table


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, per=85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: non-blank lines before, lines deleted, the longest repeated run it takes part in, and the text left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_lines", F.size(linededup.numbered_lines(F.col("text"))).cast("long"))
    got = linededup.dedup_lines(docs, with_runs=True)
    return got.select("doc_id", "n_lines", F.col("_tl_deleted").cast("long").alias("n_deleted"), F.col("_tl_longest").cast("long").alias("longest_run"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.train(docs.where(~out))
    return langid.identify(docs, model).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, recall = embed.near_duplicates(table(spark, sf_dir, "embeddings"))
    return got.withColumn("audited_recall", F.lit(recall))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = lm.score(docs, ~out)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_passages(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencounts.edited_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxsketch.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.top_products(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return gnat.hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination, "op7_minhash_near_dedup": op7_minhash_near_dedup, "op10_line_dedup": op10_line_dedup, "op3_language_id": op3_language_id, "op1_packing": op1_packing, "op5_warc": op5_warc, "op6_embedding_near_dedup": op6_embedding_near_dedup, "op8_lm_scoring": op8_lm_scoring, "op4_suffix_array_dedup": op4_suffix_array_dedup, "op9_token_counts": op9_token_counts, "op11_lexical_search": op11_lexical_search, "op12_exact_topk": op12_exact_topk, "op13_hard_negatives": op13_hard_negatives}

SQL = {
    "op2_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (
  SELECT DISTINCT item_id, len, array_to_string(w[s:s + len - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS len, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
g AS (
  SELECT doc_id, len, s, array_to_string(w[s:s + len - 1], ' ') AS win
  FROM (SELECT doc_id, w, len, unnest(generate_series(1, len(w) - len + 1)) AS s FROM d, (SELECT DISTINCT len FROM i) WHERE len(w) >= len)),
h AS (SELECT doc_id, s, g.len, item_id FROM g JOIN i ON g.len = i.len AND g.win = i.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + len - 1)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op7_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(3, len(w)) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
m AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op10_line_dedup": r"""
WITH a AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
l AS (SELECT doc_id, i, line, length(line) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o FROM a WHERE trim(line) <> ''),
w AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY o) AS line2,
    row_number() OVER (PARTITION BY line ORDER BY doc_id, o) > 1 AS copy1
  FROM l),
x AS (SELECT *, line2 IS NOT NULL AND row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, o) > 1 AS copy2 FROM w),
g AS (SELECT doc_id, o, i, line, (copy1 AND chars >= 80) OR copy2 OR coalesce(lag(copy2) OVER (PARTITION BY doc_id ORDER BY o), false) AS gone FROM x),
p AS (
  SELECT a.doc_id AS d, a.o AS o, b.doc_id AS e, b.o - a.o AS diag FROM l a JOIN l b ON a.line = b.line AND (a.doc_id <> b.doc_id OR a.o <> b.o)),
r AS (SELECT d, max(n) AS longest FROM (SELECT d, count(*) AS n FROM (SELECT *, o - row_number() OVER (PARTITION BY d, e, diag ORDER BY o) AS k FROM p) GROUP BY d, e, diag, k) GROUP BY d),
k AS (
  SELECT doc_id, count(o) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted,
    string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS rest
  FROM (SELECT a.doc_id, a.i, a.line, g.o, coalesce(g.gone, false) AS gone FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.i = g.i) GROUP BY doc_id)
SELECT k.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_deleted AS BIGINT) AS n_deleted, CAST(coalesce(longest, 0) AS BIGINT) AS longest_run,
  sha256(CASE WHEN n_deleted = 0 THEN coalesce(text, '') WHEN trim(replace(rest, chr(10), ' ')) = '' THEN '' ELSE coalesce(rest, '') END) AS text_sha256
FROM k JOIN documents USING (doc_id) LEFT JOIN r ON r.d = k.doc_id
""",
    "op5_warc": r"""
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages WHERE page_id IS NOT NULL),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: translate(
    lpad(upper(to_base(CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT), 32)), 4, '0'), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest
  FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
""",
    "op11_lexical_search": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, row_number() OVER () AS j, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS HUGEINT) AS l FROM d WHERE len(w) > 0),
m AS (SELECT k, doc_id, CAST(75 + (25 * CAST(len(w) AS HUGEINT) * n) // l AS BIGINT) AS m FROM d, c WHERE len(w) > 0),
q AS (SELECT j, item_id, t, count(*) AS r FROM (SELECT j, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
p AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY k, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
s AS (
  SELECT j, item_id, doc_id, k, CAST(sum(r * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (k) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20
""",
    "op12_exact_topk": r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op13_hard_negatives": r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.x) = len(c.x)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
}
