"""Orders with limits, set operations, hashes and job rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import predicates


def reading_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Place of each box by (row of three points, half to even; x; kind)."""
    w = W.partitionBy(*keys).orderBy(F.bround(F.col("y0") / 3, 0), "x0", "kind", "id")
    return df.withColumn("place", F.row_number().over(w))


def queue(items: DataFrame, limit: int = 200) -> DataFrame:
    """Distinct review items, suggested ones first, by page, y and x; at most `limit`."""
    d = items.dropDuplicates(["page", "x", "y", "width", "height", "state"]).where("width > 0 and height > 0")
    return d.orderBy((F.col("state") != "suggested").cast("int"), "page", "y", "x", "reason", "category").limit(limit)


def best_methods(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Of each value the category and method of its most telling finding."""
    rank = F.array_position(F.array(*map(F.lit, predicates.METHODS)), F.col("method"))
    known = findings.withColumn("method", F.when(rank > 0, F.col("method")).otherwise("model_proposal"))
    rank = F.array_position(F.array(*map(F.lit, predicates.METHODS)), F.col("method"))
    return known.groupBy(*keys, "value").agg(F.min_by(F.struct("category", "method"), F.struct(rank, F.col("category"))).alias("b")).select(*keys, "value", "b.category", "b.method")


def audit_map(boxes: DataFrame, findings: DataFrame, limit: int = 400) -> DataFrame:
    """Drawn boxes (page, x, y, width, height, value) with category and method, without the values."""
    items = boxes.join(best_methods(findings, []), "value").drop("value").distinct()
    return items.orderBy("page", "y", "x", "width", "height", "category", "method").limit(limit)


def opening(df: DataFrame, keys: list[str], order: list[str], most: int = 1800) -> DataFrame:
    """The first texts of each document until their length passes `most`."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("before", before).where(F.col("before") < most)


def newest_then_visible(rows: DataFrame, order: list, limit: int, visible: Column) -> DataFrame:
    """The limit first: a reader may see fewer than `limit` rows."""
    return rows.orderBy(*order).limit(limit).where(visible)


def visible_then_newest(rows: DataFrame, order: list, limit: int, visible: Column) -> DataFrame:
    return rows.where(visible).orderBy(*order).limit(limit)


def after(rows: DataFrame, key: str, last: int, limit: int = 500) -> DataFrame:
    """The next page behind a key."""
    return rows.where(F.col(key) > last).orderBy(key).limit(limit)


def spot_checks(rows: DataFrame, keys: list[str], bad: Column, order: list[str], good: int) -> DataFrame:
    """The first `good` rows without a problem, and the first with one."""
    d = rows.withColumn("_bad", bad)
    n = F.row_number().over(W.partitionBy(*keys, "_bad").orderBy(*order))
    return d.withColumn("_n", n).where((~F.col("_bad") & (F.col("_n") <= good)) | (F.col("_bad") & (F.col("_n") == 1))).drop("_n").withColumnRenamed("_bad", "bad")


def canonical_json(columns: list[str]) -> Column:
    """JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def fingerprint(columns: list[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def registered(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files (id, content) whose hash and size are held against a registry (id, sha256): ok, changed, unregistered."""
    f = files.select("id", F.sha2("content", 256).alias("now"), F.octet_length("content").alias("size"))
    return f.join(registry.select("id", "sha256"), "id", "left").select("id", "size", F.when(F.col("sha256").isNull(), "unregistered").when(F.col("sha256") == F.col("now"), "ok").otherwise("changed").alias("status"))


def new_only(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with keys that are not known yet, each key once: what an idempotent import appends."""
    return rows.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")


def idempotent(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each request with the outcome of its key: created, repeated (same hash) or conflict (another hash)."""
    first = F.first("request_hash").over(W.partitionBy(*keys).orderBy(*order))
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return requests.withColumn("outcome", F.when(n == 1, "created").when(F.col("request_hash") == first, "repeated").otherwise("conflict"))


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes replace rows of their keys; of changes to one key the last (by updated) holds."""
    w = W.partitionBy(*keys).orderBy(F.desc("updated"))
    last = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows.join(last.select(*keys), keys, "left_anti").unionByName(last)


def stale(jobs: DataFrame, now: Column, grace_seconds: int) -> DataFrame:
    """Running jobs without a sign of life for longer than the grace, which is a minute at least."""
    if grace_seconds < 60:
        raise ValueError("a grace of a minute at least")
    return jobs.where("status = 'running'").where(F.coalesce("heartbeat", "updated") < now - F.make_interval(secs=F.lit(grace_seconds)))


def online(workers: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    return workers.withColumn("online", F.coalesce(F.col("heartbeat") > now - F.make_interval(secs=F.lit(seconds)), F.lit(False)))


def expired(rows: DataFrame, now: Column, hours: int, finished_only: bool = False) -> DataFrame:
    """Rows older than the retention; with finished_only no job that is still under way."""
    old = rows.where(F.col("updated") < now - F.make_interval(hours=F.lit(hours)))
    return old.where(F.col("status").isin("succeeded", "failed", "cancelled", "interrupted")) if finished_only else old


def time_limit(base: Column, pages: Column, most: int = 86400) -> Column:
    """Seconds for a job: 30 more for each page above 100, a day at most."""
    return F.least(F.lit(most), base + 30 * F.greatest(F.lit(0), pages - 100))


def accept_result(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Results by what becomes of them: accepted, replayed (same lease and hash), or refused."""
    j = jobs.select("job_id", "status", F.col("lease").alias("job_lease"), "result_hash")
    kind = F.when((F.col("status") == "running") & (F.col("job_lease") == F.col("lease")), "accepted").when((F.col("status") == "succeeded") & (F.col("job_lease") == F.col("lease")) & (F.col("result_hash") == F.col("hash")), "replayed").otherwise("refused")
    return results.join(j, "job_id", "left").select("job_id", "lease", "hash", kind.alias("outcome"))


def join_split_dates(lines: DataFrame, keys: list[str]) -> DataFrame:
    """'2024-03-' with '18' directly below it, as one date, if the calendar knows it: id, next_id, value."""
    w = W.partitionBy(*keys).orderBy("y0", "x0", "id")
    nxt = lambda c: F.lead(c).over(w)
    whole = F.concat("text", nxt("text"))
    ok = F.col("text").rlike(r"^\d{4}-\d{2}-$|^\d{4}-$") & nxt("text").rlike(r"^\d{2}(?:-\d{2})?$") & (F.abs(nxt("x0") - F.col("x0")) <= 3) & whole.rlike(r"^\d{4}-\d{2}-\d{2}$") & whole.try_cast("date").isNotNull()
    return lines.select(*keys, "id", nxt("id").alias("next_id"), whole.alias("value"), ok.alias("_ok")).where("_ok").drop("_ok")
