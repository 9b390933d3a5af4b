"""Operator 3: token counts as delta-maintained rollups.

A change feed of signed rows (insert, delete, revise) is rolled up to (source, lang, tokenizer) before it is stored: a
batch is a few additive totals, however many documents it changes. A batch is committed under its id by one rename, so a
replay or a retry after a failure counts once; totals are the sum over committed batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm._shared import shared_dir

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"

#: Tokenizer versions that are plain expressions of a text. Others can be given as columns or by token_changes().
COUNTERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda t: F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")),
    "bytes-1": lambda t: F.octet_length(t),
}


def counted(docs: DataFrame, counters: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) for every row of docs and tokenizer version.

    A null or empty text counts 0; null keys stay; repeated rows count each time; very long texts are counted whole, by
    expressions; other columns are not read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = F.array(*(F.struct(F.lit(v).alias("tokenizer"), f(text).cast("long").alias("n_tokens")) for v, f in (counters or COUNTERS).items()))
    return docs.select("doc_id", "source", "lang", F.explode(counts).alias("c")).select("doc_id", "source", "lang", "c.*")


def deltas(changes: DataFrame) -> DataFrame:
    """Roll up a change feed to additive totals, one row a key.

    changes: op ('insert', 'delete' or 'revise'), source, lang, tokenizer, n_tokens, and for a revision old_n_tokens
    (with old_source and old_lang if these columns are there; null in them means null). An insert adds one document and
    its tokens, a delete takes them away, a revision takes the old and adds the new. Null counts are 0; null keys are a
    group of their own; repeated rows count each time; another op, or none, is refused. An empty feed has no rows."""
    moved = {"old_source", "old_lang"} <= set(changes.columns)
    old = F.col("old_n_tokens") if "old_n_tokens" in changes.columns else F.lit(0)
    known = F.col("op").isin("insert", "delete", "revise")
    op = F.when(F.coalesce(known, F.lit(False)), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(F.col("op"), F.lit("null")))))
    new_row = lambda n, d: F.struct(F.col("source").alias("source"), F.col("lang").alias("lang"), F.lit(d).cast("long").alias("documents"), n.cast("long").alias("tokens"))
    tokens = F.coalesce("n_tokens", F.lit(0))
    was = F.struct(F.col("old_source" if moved else "source").alias("source"), F.col("old_lang" if moved else "lang").alias("lang"), F.lit(-1).cast("long").alias("documents"), (-F.coalesce(old, F.lit(0))).cast("long").alias("tokens"))
    signed = F.when(op == "insert", F.array(new_row(tokens, 1))).when(op == "delete", F.array(new_row(-tokens, -1))).otherwise(F.array(was, new_row(tokens, 1)))
    flat = changes.select("tokenizer", F.explode(signed).alias("s")).select("s.source", "s.lang", "tokenizer", "s.documents", "s.tokens")
    return flat.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals in a folder that every executor and the driver share (any Hadoop file system with an atomic rename)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folder(self, batch_id: str) -> str:
        if not batch_id or any(not (c.isalnum() or c in "-_.") for c in batch_id):
            raise ValueError("a batch id is made of letters, digits, '-', '_' and '.'")
        return f"{self.path}/batches/batch={batch_id}"

    def batches(self) -> list[str]:
        fs, p = self._fs(f"{self.path}/batches")
        return sorted(s.getPath().getName().removeprefix("batch=") for s in fs.listStatus(p)) if fs.exists(p) else []

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes, once: False, and nothing done, if a batch of this id is committed."""
        target = self._folder(batch_id)
        fs, to = self._fs(target)
        if fs.exists(to):
            return False
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(staged)
        _, parent = self._fs(f"{self.path}/batches")
        fs.mkdirs(parent)
        _, source = self._fs(staged)
        moved = not fs.exists(to) and fs.rename(source, to)
        _, nested = self._fs(f"{target}/{staged.rsplit('/', 1)[1]}")
        if moved and not fs.exists(nested):
            return True
        # another writer came first (where a rename goes below its folder, it is taken away again), or the rename failed
        fs.delete(nested if moved else source, True)
        if not fs.exists(to):
            raise OSError(f"batch {batch_id} could not be committed")
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all committed batches; keys that came to nothing are left out."""
        paths = [self._folder(b) for b in self.batches()]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")


def new_rollup(spark: SparkSession) -> Rollup:
    return Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
