"""The registered queries of the corpus operators, one for each, over whole tables, and SQL for those it can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.llm import align, decontaminate, licenses, line_dedup, lm, minhash, mixing, prefix_trie, secrets, token_store, topk, toxicity, url_filter
from noctua.llm.common import table

#: Allow and block rules of op9_url_filter.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A file of $NOCTUA_TOKENIZERS, or else of the installed public tokenizers."""
    folder = os.environ.get("NOCTUA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    vectors = table(spark, sf_dir, "embeddings").where(x.isNotNull() & ~odd).select("vec_id", F.transform(x, lambda e: F.floor(64 * e.cast("double"))).alias("v"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return toxicity.fit(docs, labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return lm.score_texts(docs.select("doc_id", "text", held_out.alias("held_out")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("found")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES)
    return url_filter.url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_tokens(table(spark, sf_dir, "documents"), token_store.fresh_path(spark), tokenizer_file())
    return token_store.token_digests(spark, path)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align_tokenizers(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")).select("doc_id", *align.COLUMNS)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_topk, op3_mixing, op4_minhash, op5_toxicity, op6_language_model, op7_secrets, op8_licenses, op9_url_filter, op10_token_files, op11_alignment, op12_line_dedup, op13_prefix_trie)
}

ORACLE_SQL = {
    "op2_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op9_url_filter": """
WITH rules(h, p, a) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM u),
m AS (
  SELECT n, h || p AS rule, a, row_number() OVER (PARTITION BY n ORDER BY length(h || p.p) DESC) AS k
  FROM (SELECT p.n, p.host, p.path AS pth, r.h, r.p, r.a FROM p JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) p)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.a, 'allow') AS verdict FROM p LEFT JOIN m ON m.n = p.n AND m.k = 1
""",
    "op12_line_dedup": """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.*, often.key IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op13_prefix_trie": """
WITH raw AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
crc AS (  -- crc32 of the decimal form, a byte at a time
  SELECT c, c - c % 100 AS base, s, 4294967295::BIGINT AS x, 1 AS i FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM raw)),
bits AS (
  WITH RECURSIVE go(c, base, s, x, i, k) AS (
    SELECT c, base, s, xor(x, CAST(ord(substr(s, 1, 1)) AS BIGINT)), 1, 0 FROM crc
    UNION ALL
    SELECT c, base, s,
           CASE WHEN k < 8 THEN CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
                ELSE xor(x, CAST(ord(substr(s, i + 1, 1)) AS BIGINT)) END,
           CASE WHEN k < 8 THEN i ELSE i + 1 END, CASE WHEN k < 8 THEN k + 1 ELSE 0 END
    FROM go WHERE k < 8 OR i < length(s))
  SELECT c, base, xor(x, 4294967295::BIGINT) % 6 AS h FROM go WHERE k = 8 AND i = length(s)),
lent AS (SELECT b.c, r.p AS d, r.role, r.text FROM bits b JOIN raw r ON r.c = b.base AND r.p <= b.h),
both_ AS (
  SELECT c, 0 AS own, d, role, text FROM lent
  UNION ALL SELECT r.c, 1, r.p, r.role, r.text FROM raw r JOIN bits b ON b.c = r.c WHERE r.p > b.h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, d) AS d, role, text FROM both_),
paths AS (
  SELECT c, d, length(text) AS size, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS key FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM bits),
steps AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS before, max(d) OVER (PARTITION BY c) = d AS ends FROM paths),
nodes AS (
  SELECT d, key, min(c) AS conv, any_value(before) AS before, count(*) AS n, any_value(size) AS size,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS done
  FROM steps GROUP BY d, key),
kids AS (SELECT before AS key, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY before),
full_ AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (key)),
below AS (
  SELECT a.key, count(*) FILTER (WHERE f.kids = 0) AS leaves, sum((f.n - 1) * f.size) AS saved
  FROM full_ f JOIN steps a ON a.c = f.conv AND a.d <= f.d GROUP BY a.key)
SELECT f.conv AS conv_id, CAST(f.d AS BIGINT) AS depth, up.conv AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(f.done) AS ends_sha256
FROM full_ f JOIN below USING (key) LEFT JOIN nodes up ON up.key = f.before AND f.d > 0
""",
}
