"""A training-data pipeline: quality, near-dedup, substring dedup, decontamination, tokens.

Each stage takes what its predecessor kept. Written and read again between stages, so a lost executor costs one stage.

In every stage a null text counts as empty, a row without a doc_id stays a row, equal rows are equally treated, texts of
any length are read whole, columns beside those of documents are not read, and an empty table gives an empty one. What a
stage does otherwise with such rows, its docstring says.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm import byte_bpe, decontaminate, near, quality, substring
from vellumite.llm._shared import delete_path, scratch, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Empty texts are scored like others; repeated rows all stay or all go."""
    carry = tuple(c for c in COLUMNS if c != "doc_id")
    return quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=carry).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of all that reach each other over pairs of 5-word Jaccard similarity >= 0.8.

    It is the row of least doc_id; a row without one stays only where no other row of its group has one. Of rows that
    agree in doc_id, one is chosen by a digest of the row; of rows that agree in all columns, one stays."""
    keyed = docs.select(*COLUMNS, F.sha2(F.to_json(F.struct(*COLUMNS)), 256).alias("row_key"))
    found = near.grouped(keyed.select(F.struct("doc_id", "row_key").alias("id"), "text"))
    rows = found.groupBy("component", "id").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("id.doc_id").isNull().alias("unnamed"), F.col("id.doc_id"), F.col("id.row_key"), F.col("copies"))
    heads = rows.groupBy("component").agg(F.min(order).alias("head")).select("head.row_key", "head.copies")
    out = keyed.join(heads, "row_key")
    repeated = out.where("copies > 1").dropDuplicates(["row_key"])
    return out.where("copies = 1").union(repeated).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that an earlier document has; documents of which nothing is left go.

    Rows without a doc_id have no place in the order: they stay as they are and take nothing from others."""
    cut = substring.removed(docs, keep_text=True).where("n_removed > 0").select("doc_id", "digest", "kept_text")
    keyed = docs.withColumn("digest", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    out = keyed.join(cut, ["doc_id", "digest"], "left").where("kept_text is null or kept_text <> ''")
    text = F.coalesce("kept_text", "text")
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")).alias("n_chars"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows without a doc_id, and repeated ones, go if their text holds one."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes that they decode to. An empty text has none."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, space_leads=True, keep_ids=True, carry=("lang", "source"))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark),
    ("tokens", encode),
]

#: Not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete_path(spark, last)
        last = path
    return docs
