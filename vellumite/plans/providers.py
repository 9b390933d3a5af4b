"""A seam for model answers: distinct requests go out once, answers come back by key.

A provider is any function of a DataFrame (key, payload) to (key, answer). The offline one finds nothing, so that flows
run without a model, deterministically."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[DataFrame], DataFrame]


def offline(requests: DataFrame) -> DataFrame:
    return requests.select("key", F.lit('{"findings":[]}').alias("answer"))


def asked_once(rows: DataFrame, payload: str, provider: Provider) -> DataFrame:
    """rows with the answer to their payload; equal payloads are one request."""
    keyed = rows.withColumn("key", F.sha2(F.coalesce(F.col(payload), F.lit("")), 256))
    answers = provider(keyed.select("key", F.col(payload).alias("payload")).dropDuplicates(["key"]))
    return keyed.join(answers, "key", "left").drop("key")


def batches(rows: DataFrame, keys: list[str], item: str, size: int) -> DataFrame:
    """Items in numbered groups of `size`, for providers that take several at once."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(*keys).orderBy(item)) - 1
    return rows.withColumn("batch", F.floor(n / size)).groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(item)).alias("items"))


def chunks(rows: DataFrame, keys: list[str], order: list[str], most: int = 6000) -> DataFrame:
    """Texts in consecutive groups of about `most` characters."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("chunk", F.floor(F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)) / most))


KINDS = {
    "timestamp": r"^\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})?$",
    "date": r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})$",
    "ip_address": r"^(?:\d{1,3}\.){3}\d{1,3}$",
    "identifier": r"^(?=.*\d)[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)+$",
}


def field_kind(c):
    """The kind of a field value by its form, if all its parts between ';' have it; null leaves it to a model."""
    parts = F.transform(F.split(c, ";"), lambda p: F.trim(p))
    out = F.lit(None).cast("string")
    for name, form in reversed(KINDS.items()):
        out = F.when(F.forall(parts, lambda p, form=form: p.rlike(form)), name).otherwise(out)
    return out
