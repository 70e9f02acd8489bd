"""The queries of this package: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, mixing, simhash, substring_dedup, token_counts, tokens, topk, toxicity, warc


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").alias("n_draws"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), piece_vocabulary())


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tokens.tokenize(_table(spark, sf_dir, "documents"), byte_bpe())
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("bm25", "overlap", "question_overlap", "answer_overlap")])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def substring_dedup_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broadcast form of the tenth operator: automata of the benchmark's texts, through which all documents stream."""
    kept = substring_dedup.dedup_against(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_token_counts, op3_token_files, op4_line_dedup, op5_simhash, op6_toxicity, op7_top_k, op8_warc, op9_decontaminate, op10_substring_dedup, substring_dedup_against)}


#: DuckDB SQL of the operators that SQL can express.
OP4_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM docs),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
marked AS (
  SELECT d.r, d.doc_id, d.line, d.k, (o.key IS NOT NULL AND o.last_doc IS DISTINCT FROM d.doc_id) AS gone FROM keyed d LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""


#: Too slow for whole large tables in a database, yet exact: all pairs of queries and rows.
OP7_SQL = """
WITH good AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) for x in embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS nth FROM wins),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE nth > 1),
all_words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
marked AS (
  SELECT a.doc_id, a.word, a.p, g.p IS NOT NULL AS gone FROM all_words a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(m.p) FILTER (m.gone) AS n_removed,
       sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.p) FILTER (NOT m.gone), '')) AS kept_sha256
FROM d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id, d.w
"""


AGAINST_SQL = r"""
WITH d AS (
  SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
b AS (
  SELECT [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM benchmark),
known AS (
  SELECT DISTINCT array_to_string(w[i : i + 19], ' ') AS key FROM (SELECT w, unnest(range(1, len(w) - 18)) AS i FROM b)),
wins AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM wins JOIN known USING (key)),
all_words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
marked AS (
  SELECT a.doc_id, a.word, a.p, g.p IS NOT NULL AS gone FROM all_words a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(m.p) FILTER (m.gone) AS n_removed,
       sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.p) FILTER (NOT m.gone), '')) AS kept_sha256
FROM d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id, d.w
"""


def oracle_sql() -> dict[str, str]:
    return {"substring_dedup_against": AGAINST_SQL, "op4_line_dedup": OP4_SQL, "op7_top_k": OP7_SQL, "op8_warc": OP8_SQL, "op10_substring_dedup": OP10_SQL}
