"""The thin queries of this subpackage: tables in, contract columns out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_id, mixing, quality, simhash, substring_dedup, suffix_dedup, topk, url_filter
from .common import fresh_path, read_table
from .token_counts import token_counts


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.remove_repeats(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


def held_out():
    """Documents whose language labels are kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(3)) == 1, F.lit(False))


def language_model(docs: DataFrame) -> language_id.LanguageModel:
    return language_id.fit(docs.where(~held_out() & F.col("lang").isNotNull()).select("text", "lang"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_rejected")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # a cluster that names a folder keeps its counts from run to run
    cache = spark.conf.get("spark.textloom.tokenCache", None) or fresh_path(spark, "token_cache")
    counted = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


#: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_bpe_roundtrip": op3_bpe_roundtrip,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_topk": op8_topk,
    "op9_url_filter": op9_url_filter,
    "op10_quality": op10_quality,
}

#: The others have no SQL: hash functions, tokenizers, compressors and folds that DuckDB lacks.
ORACLE_SQL = {
    "op1_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM windows JOIN firsts USING (win) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY words.p) AS kept FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_suffix_dedup": """WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
parts AS (SELECT doc_id, j, len(h) // 2 AS n, substr(h, 512 * j + 1, 610) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 512 + 1)) AS j FROM d)),
windows AS (SELECT doc_id, 256 * j + k AS i, substr(g, 2 * k + 1, 100) AS win FROM (SELECT doc_id, j, n, g, unnest(range(0, 256)) AS k FROM parts) WHERE 256 * j + k + 50 <= n),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY 1),
starts AS (SELECT doc_id, i FROM windows JOIN firsts USING (win) WHERE first < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM starts),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY 1, 2),
before AS (SELECT doc_id, k, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM spans),
kept AS (SELECT before.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM before JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
