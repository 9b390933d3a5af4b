"""The queries of this subpackage, with production parameters over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm import byte_bpe, decontaminate, licenses, quality, sharding, simhash, substring, suffix_dedup, token_counts, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, then revised from words-1 counts of zero, the longest class is deleted; each batch is sent twice."""
    counts = token_counts.counted(table(spark, sf_dir, "documents"))
    rollup = token_counts.new_rollup(spark)
    batches = {
        "0001-load": counts.withColumn("op", F.lit("insert")),
        # a recount under a new way of counting bytes: four bytes a unit, rounded up
        "0002-recount": counts.where("tokenizer = 'bytes-1'").select("doc_id", "source", "lang", "tokenizer", F.lit("revise").alias("op"), F.col("n_tokens").alias("old_n_tokens"), F.ceil(F.col("n_tokens") / 4).alias("n_tokens")),
        # documents of fewer than 20 words leave the corpus
        "0003-short": counts.where("tokenizer = 'words-1' and n_tokens < 20").withColumn("op", F.lit("delete")),
    }
    for batch_id, changes in batches.items():
        rollup.commit(batch_id, changes)
        rollup.commit(batch_id, changes)  # a replay counts once
    return rollup.totals()


OP3_SQL = r"""
WITH own AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words, strlen(coalesce(text, '')) AS n_bytes FROM documents),
both_kinds AS (
    SELECT source, lang, 'words-1' AS tokenizer, 1 AS d, n_words AS n FROM own WHERE n_words >= 20
    UNION ALL SELECT source, lang, 'bytes-1', 1, CAST(ceil(n_bytes / 4.0) AS BIGINT) FROM own)
SELECT source, lang, tokenizer, CAST(sum(d) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS tokens FROM both_kinds GROUP BY ALL"""


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


OP5_SQL = """
WITH v AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    # in this pattern a space between two other characters only leads a piece
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, space_leads=True)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), count=40)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_suffix_array_dedup, op2_quality_classifier, op3_token_counts, op4_benchmark_decontamination, op5_exact_top_k, op6_license_scan, op7_byte_bpe, op8_sharding, op9_substring_dedup, op10_simhash)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_token_counts": OP3_SQL, "op5_exact_top_k": OP5_SQL, "op6_license_scan": licenses.scan_sql()}
