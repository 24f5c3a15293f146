"""The queries of the operators over the tables of a scale folder, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination, jaccard, language, mixing, quality, sharding, token_counts, topk, toxicity, warc
from factloom.llm.common import crc_mod

#: The rank file of op10; a parameter, never part of the repository.
VOCABULARY = os.environ.get("FACTLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the factorisation machine."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(documents, labels, "quality", crc_mod("doc_id", 5) != 0)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(True)).alias("held_out")
    scored = quality.score(documents.select("doc_id", "text", "n_chars"), model)
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by naive Bayes."""
    documents = table(spark, sf_dir, "documents")
    model = language.train(documents, crc_mod("doc_id", 4) != 2)
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True)).alias("held_out")
    return language.predict(documents.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 5-word shingle Jaccard of 0.75 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by FTRL-proximal logistic regression."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels, "toxic", crc_mod("doc_id", 5) != 0)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(True)).alias("held_out")
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document so that sources meet their targets."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derivatives(warc.responses_of(table(spark, sf_dir, "pages")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by jump consistent hashing of its id."""
    sharded = sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 40, keep_text=False)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every query vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each context limit gives, from the histogram of encoded lengths."""
    return token_counts.with_suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents"), VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_language, op3_jaccard, op4_toxicity, op5_mixing, op6_warc, op7_sharding, op8_topk, op9_decontamination, op10_token_counts)
}

#: DuckDB SQL where it can express the query.  op1, op2, op4 (trained models), op6
#: (page text), op7 (crc32) and op10 (a tokenizer) are tested by other means.
ORACLE_SQL: dict[str, str] = {
    "op3_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)""",
    "op5_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
q AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
o AS (SELECT *, source_size * 3.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST) AS i, sum(source_size) OVER ()::DOUBLE AS total FROM q),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share FROM o),
g AS (SELECT *, share >= cap / weight AS is_full, max(CASE WHEN share < cap / weight THEN share END) OVER () AS rate FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE rate * weight END AS target FROM g),
v AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-12), 3) ELSE 0 END::BIGINT AS passes FROM t),
u AS (SELECT d.*, v.source_size, v.target, v.passes, greatest(v.target - v.passes * v.source_size, 0::DOUBLE) AS rest FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
b AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM u)
SELECT doc_id, size, source_size, target,
  (size * passes + CASE WHEN upto <= rest THEN size WHEN upto - size < rest THEN floor(rest - (upto - size)) ELSE 0 END)::BIGINT AS taken
FROM b""",
    "op8_topk": r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT doc_id, g.i, g.n, item FROM g JOIN i USING (g, n)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
