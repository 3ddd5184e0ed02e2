"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from . import decontaminate, exact_dedup, language, licenses, line_dedup, packing, quality, ranked, repetition, sharding, simhash, warc, whitening
from .common import prepare, scratch_path

SEQUENCE = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def tokenizer_path() -> str:
    """The public byte-level BPE file; the same path on every machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def hex16(col: str):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return found.select(F.col("id").alias("doc_id"), hex16("fp").alias("fingerprint"), "component_id")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(prepare(spark), f"archive-{uuid.uuid4().hex[:8]}")
    warc.write_archive(_table(spark, sf_dir, "pages"), path, min_bytes=0)
    back = warc.read_archive(spark, path)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to AS long)").alias("refers_to"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7).withColumnRenamed("id", "doc_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=8)
    return dealt.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=5, min_chars=40)
    return left.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), language.held_out("id").alias("held_out"), "lang_pred", "score", F.array_join("langs", ",").alias("langs"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE).withColumnRenamed("id", "doc_id").drop("ids")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.judge(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), wanted=4).withColumnRenamed("id", "vec_id")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS x,
             max(page_id) OVER (PARTITION BY html) AS top,
             row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS nth FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, CAST(1 + 5 * i AS INT), 5) AS BIGINT)) AS parts FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(parts, lambda v:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> 15) & 31) + 1 AS INT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> 10) & 31) + 1 AS INT), 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> 5) & 31) + 1 AS INT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth = 1 THEN NULL ELSE top END AS refers_to
FROM v
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, i, line, r.key IS NOT NULL AND k.doc_id <> r.holder AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS a FROM documents),
d AS (SELECT r, doc_id, CAST(len(a) AS BIGINT) AS n, a FROM t WHERE len(a) > 0),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(a) AS term FROM d) GROUP BY r, term),
p AS (SELECT * FROM w WHERE term IN (SELECT term FROM q)),
f AS (SELECT term, CAST(floor(1000 * ln((2 * s.nn + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, s.nn),
c AS (SELECT q.item_id, d.r, d.doc_id, CAST(sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * d.n * s.nn) // s.l)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN d ON d.r = p.r, s GROUP BY q.item_id, d.r, d.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rk FROM c WHERE score > 0)
SELECT item_id, CAST(rk AS INT) AS rank, doc_id, score FROM o WHERE rk <= 50
"""

#: The longest repeat is over 50 words if some run of 51 words occurs twice.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS a FROM d),
w AS (SELECT r, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS word, len(a) AS n FROM a),
g AS (SELECT r, i, n, word, CASE WHEN i + 4 <= n THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) END AS five,
             CASE WHEN i + 50 <= n THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING) END AS long FROM w),
h AS (SELECT r, i, word, five IS NOT NULL AND count(*) OVER (PARTITION BY r, five) > 1 AS twice, long IS NOT NULL AND count(*) OVER (PARTITION BY r, long) > 1 AS over FROM g),
c AS (SELECT r, word, over, max(CAST(twice AS INT)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 1 AS covered FROM h),
s AS (SELECT r, count(*) AS n_words, sum(length(word)) AS chars, count(*) FILTER (WHERE covered) AS rep, coalesce(sum(length(word)) FILTER (WHERE covered), 0) AS rep_chars, bool_or(over) AS over FROM c GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS dups FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT d.r, doc_id, t, coalesce(n_words, 0) AS n_words, coalesce(chars, 0) AS chars, coalesce(rep, 0) AS rep, coalesce(rep_chars, 0) AS rep_chars, coalesce(over, false) AS over, coalesce(dups, 0) AS dups
      FROM d LEFT JOIN s ON s.r = d.r LEFT JOIN l ON l.r = d.r)
SELECT doc_id, n_words, CAST(chars AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, dups AS n_dup_lines, rep AS n_repeat_words,
       n_words < 10 OR 100 * rep > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * rep > 20 * n_words) AND rep_chars <= 0.25 * chars AND NOT over AS kept
FROM f
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1,
    "op2_warc_archive": op2,
    "op3_quality_classifier": op3,
    "op4_license_scan": op4,
    "op5_shard_longest_first": op5,
    "op6_exact_dedup": op6,
    "op7_benchmark_decontamination": op7,
    "op8_line_dedup": op8,
    "op9_language_id": op9,
    "op10_curve_packing": op10,
    "op11_ranked_search": op11,
    "op12_repetition_rules": op12,
    "op13_whitening": op13,
}
SQL = {"op2_warc_archive": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op8_line_dedup": OP8_SQL, "op11_ranked_search": OP11_SQL, "op12_repetition_rules": OP12_SQL}
