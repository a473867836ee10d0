"""The queries of the corpus operators: name -> f(spark, sf_dir), and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, context_tree, language_id, mixing, pii, quality_rules, repeats, simhash_dedup, token_store, va_file
from .common import shared_path, table, written


#: What op6 rakes to; languages that aren't named, sources and topics get tempered shares.
TARGETS: dict[str, dict[str | None, float]] = {"lang": {"en": 0.5, "de": 0.2}}
#: Its largest weight.
MOST = 5.0


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents")).drop("kept")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=2, vocabulary=49_408)
    return token_store.read(spark, path)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.weigh(table(spark, sf_dir, "documents"), targets=TARGETS, most=MOST)
    named = [F.col(f"mix_{a}").alias(a) for a in mixing.AXES]
    return out.select("doc_id", *named, "n_tokens", F.round("weight", 6).alias("weight"), F.round("rate", 6).alias("rate"), "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    out = language_id.learn_and_predict(docs, public_tokenizers.path("piece_bpe_32k.model"), F.col("held_out"), ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return context_tree.score(table(spark, sf_dir, "documents"), held_out)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(simhash_dedup.fingerprints(table(spark, sf_dir, "documents"), 3, 64), "prints")
    return simhash_dedup.components(prints, 3, 64).select("doc_id", "fingerprint", "component_id")


def op9_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256.0)


_OP9 = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


_OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS s FROM d)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
marked AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM again),
runs AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS b
  FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
kept AS (
  SELECT doc_id, count(a) AS n, coalesce(sum(b - a), 0) AS removed,
         coalesce(string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a), '') || substr(any_value(h), CAST(2 * coalesce(max(b), 0) + 1 AS BIGINT)) AS rest,
         any_value(len(h) // 2) AS size
  FROM d LEFT JOIN gaps USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(n AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 counts in every text before any rule is learned."""
    stats = quality_rules.text_statistics(table(spark, sf_dir, "documents"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"))


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much op8 finds of each kind in every text as it is written."""
    return pii.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


_BASE_QUALITY = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
grams AS (SELECT doc_id, t, w, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2]) AS g,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
windows AS (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM (SELECT row, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM (SELECT row_number() OVER () AS row, g FROM grams))),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM windows, range(3) r(k) WHERE n > 1 GROUP BY row),
counts AS (SELECT row_number() OVER () AS row, doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines FROM grams)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed FROM counts LEFT JOIN covered USING (row)
"""

_BASE_PERSONAL_DATA = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') AS ip,
  list_transform(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
  list_transform(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM d),
summed AS (SELECT *, list_transform(list_filter(card, lambda x: length(x) BETWEEN 13 AND 19), lambda x: list_sum(list_transform(range(1, length(x) + 1),
  lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(x)[i] AS INT) ELSE (2 * CAST(reverse(x)[i] AS INT)) // 10 + (2 * CAST(reverse(x)[i] AS INT)) % 10 END))) AS luhn FROM found)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
  CAST(len(list_filter(ip, lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(p, 3) AS INT) <= 255)))) AS BIGINT) AS n_ip,
  CAST(len(list_filter(luhn, lambda s: s % 10 = 0)) AS BIGINT) AS n_card, CAST(len(list_filter(phone, lambda x: length(x) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM summed
"""


QUERIES = {f.__name__: f for f in (op1_context_tree, op2_simhash, op3_repeats, op4_token_store, op5_byte_bpe, op6_mixing, op7_language_id, op8_pii, op9_va_file, op10_quality_rules, base_quality, base_personal_data)}
ORACLES: dict[str, str] = {"op3_repeats": _OP3, "op9_va_file": _OP9, "base_quality": _BASE_QUALITY, "base_personal_data": _BASE_PERSONAL_DATA}
