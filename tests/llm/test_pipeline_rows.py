import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import prose

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA)


def names(df):
    return Counter((r.doc_id, r.source) for r in df.collect())


def test_near_dedup_of_null_and_repeated_ids(spark):
    rng = random.Random(7)
    a, b, c, d, e, f, g = (prose(rng, 60) for _ in range(7))
    docs = frame(spark, (None, a, "alone"), (None, b, "copy"), (5, b, "named"), (None, c, "null pair"), (None, c + " end", "null pair"),
                 (6, d, "twice"), (6, d, "twice"), (1, e, "head"), (7, e, "mate"), (7, f, "mate's other"), (None, g, "null twice"), (None, g, "null twice"))
    got = names(corpus_pipeline.drop_near_duplicates(spark, docs, SF))
    assert got == Counter([(None, "alone"), (5, "named"), (None, "null pair"), (6, "twice"), (1, "head"), (7, "mate's other"), (None, "null twice")])


def test_decontamination_of_null_and_repeated_ids(spark):
    rng = random.Random(8)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = frame(spark, (None, f"{prose(rng, 9)} {item}", "dirty"), (None, prose(rng, 30), "clean"), (3, f"{item} {prose(rng, 9)}", "dirty"), (3, prose(rng, 30), "clean"), (4, item, "dirty"), (4, item, "dirty"))
    assert names(corpus_pipeline.drop_benchmark(spark, docs, SF)) == Counter([(None, "clean"), (3, "clean")])


def test_other_stages_keep_null_and_repeated_ids(spark):
    rng = random.Random(9)
    passage = prose(rng, 80)
    docs = frame(spark, (1, f"{passage} {prose(rng, 9)}", "first"), (None, passage, "null"), (2, f"{prose(rng, 7)} {passage}", "cut"), (2, f"{prose(rng, 7)} {passage}", "cut other"), (3, prose(rng, 20), "twice"), (3, prose(rng, 20), "other"))
    docs = docs.union(docs.where("source = 'twice'"))
    out = corpus_pipeline.drop_repeated_passages(spark, docs, SF)
    assert names(out) == names(docs)
    assert {r.source: len(r.text.split()) for r in out.collect()} == {"first": 89, "null": 80, "cut": 7, "cut other": 7, "twice": 20, "other": 20}
    assert names(corpus_pipeline.encode(spark, docs, SF)) == names(docs)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    once = {r.text for r in corpus_pipeline.keep_quality(spark, real, SF).collect()}
    nulls = real.where("doc_id % 2 = 0").withColumn("doc_id", F.lit(None).cast("long"))
    kept = Counter(r.text for r in corpus_pipeline.keep_quality(spark, real.union(nulls), SF).where("doc_id is null").collect())
    assert kept == Counter(r.text for r in nulls.collect() if r.text in once)
