"""All named queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, with its SQL."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"""SELECT lang, count(*) AS n FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(text, '{EMAIL}')) AS value FROM documents) GROUP BY lang""")
def pii_email_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.regexp_extract_all("text", F.lit(f"({EMAIL})"))).alias("value"))
    return found.distinct().groupBy("lang").agg(F.count("*").alias("n"))


def _load() -> None:
    for name in ("queries_text", "queries_geometry", "queries_jobs", "queries_flows"):
        importlib.import_module(f"vellumite.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
