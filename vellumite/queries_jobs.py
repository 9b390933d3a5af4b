"""Queries over events and jobs: `events` as telemetry, `orders` as jobs, `customer` as owners."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumite.catalog import query, table
from vellumite.operators import aggregates, joins, selection, windows

NOW = "TIMESTAMP '1998-01-01 00:00:00'"
JOBS = """job AS (SELECT o_orderkey AS job_id, o_custkey AS owner, o_custkey % 20 AS worker, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status,
    o_orderdate AS updated, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS heartbeat, o_totalprice AS price, o_orderpriority AS priority FROM orders)"""


def now():
    return F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")


def jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    when = F.col("o_orderdate").cast("timestamp_ntz")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner"), (F.col("o_custkey") % 20).alias("worker"), status.alias("status"), when.alias("updated"), F.when(F.col("o_orderkey") % 3 != 0, when).alias("heartbeat"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def nearest_rank_latency(spark, sf_dir):
    """Order statistics (AGG-11)."""
    return aggregates.exact_rank(events(spark, sf_dir), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def upper_median(spark, sf_dir):
    """sorted[n // 2] (AGG-08)."""
    return aggregates.upper_median(events(spark, sf_dir), ["event_type"], "value")


@query("SELECT user_id, round(coalesce(quantile_cont(value, 0.5), 10.0), 6) AS median FROM events GROUP BY user_id")
def interp_median(spark, sf_dir):
    """Median between the middle values (AGG-25)."""
    return aggregates.interpolated_median(events(spark, sf_dir), ["user_id"], "value").select("user_id", F.round("median", 6).alias("median"))


@query("""WITH p AS (SELECT event_type, ts AS t, 1 AS d FROM events UNION ALL SELECT event_type, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)), -1 FROM events),
    r AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM p) SELECT event_type, CAST(greatest(0, max(o)) AS BIGINT) AS peak FROM r GROUP BY event_type""")
def peak_in_flight(spark, sf_dir):
    """Most spans open at once, ends first (WIN-01)."""
    e = events(spark, sf_dir).select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("a"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60000000).cast("long")).alias("b"))
    return windows.peak_concurrency(e, ["event_type"], "a", "b")


@query("""WITH n AS (SELECT event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type)) - epoch_us(ts) AS us FROM events) SELECT event_type, round(sum(us) / 1e6, 3) AS seconds, count(us) AS n FROM n GROUP BY event_type""")
def stage_durations(spark, sf_dir):
    """Time from an event to the user's next (WIN-20)."""
    e = events(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return windows.stage_durations(e, ["user_id"], "ts", "event_type").groupBy("event_type").agg(F.round(F.sum("seconds"), 3).alias("seconds"), F.count("seconds").alias("n"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS transport_calls, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 6) AS http_seconds_sum, quantile_disc(value, 0.95) FILTER (event_type = 'purchase') AS p95_http_seconds,
    count(*) FILTER (event_type = 'signup' AND event_id % 4 > 1) AS retry_starts, count(*) FILTER (event_type = 'error') AS validation_failures FROM events GROUP BY user_id""")
def telemetry_summary(spark, sf_dir):
    """Transport summary by run (AGG-11)."""
    kind = F.when(F.col("event_type") == "purchase", "transport_completed").when(F.col("event_type") == "signup", "request_started").when(F.col("event_type") == "error", "validation_failed").otherwise("other")
    e = events(spark, sf_dir).select("user_id", kind.alias("event"), F.col("value").alias("seconds"), (F.col("event_id") % 4).cast("int").alias("attempt"), F.lit(None).cast("int").alias("segment_attempt"), *(F.lit(None).cast("long").alias(c) for c in ("prompt_eval_count", "eval_count", "eval_duration", "prompt_eval_duration", "load_duration")))
    return aggregates.telemetry(e, ["user_id"]).select("user_id", "transport_calls", F.round("http_seconds_sum", 6).alias("http_seconds_sum"), "p95_http_seconds", "retry_starts", "validation_failures")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY ALL")
def latest_run_per_key(spark, sf_dir):
    """Last event by user and type (AGG-14)."""
    return aggregates.latest(events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT event_type AS stage, coalesce(user_id, -1) AS document, round(sum(value), 4) AS seconds, count(*) AS spans FROM events GROUP BY ROLLUP (event_type, user_id) HAVING event_type IS NOT NULL")
def stage_audit(spark, sf_dir):
    """Stage sums by document and in total (AGG-12)."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("stage"), F.col("user_id").alias("document"), F.col("value").alias("seconds"))
    return aggregates.stage_audit(e).select("stage", F.coalesce("document", F.lit(-1)).alias("document"), F.round("seconds", 4).alias("seconds"), "spans")


@query("""WITH c AS (SELECT event_type, value AS c, CASE WHEN event_id % 3 = 0 THEN value / 2 END AS s FROM events) SELECT event_type, round(sum(c), 4) AS client_seconds, round(sum(s), 4) AS server_seconds, count(s) AS measured, round(sum(s) / sum(c) FILTER (s IS NOT NULL), 6) AS server_share FROM c GROUP BY event_type""")
def measured_transport(spark, sf_dir):
    """Server share where both sides were measured (AGG-13)."""
    e = events(spark, sf_dir).select("event_type", F.col("value").alias("client_seconds"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 2).alias("server_seconds"))
    r = lambda c, n: F.round(c, n).alias(c)
    return aggregates.measured_transport(e, ["event_type"]).select("event_type", r("client_seconds", 4), r("server_seconds", 4), "measured", r("server_share", 6))


@query("""WITH s AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS session FROM s)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM g GROUP BY ALL""")
def sessionise(spark, sf_dir):
    """Runs of events less than an hour apart (STM-05 in batch)."""
    e = events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return windows.sessions(e, ["user_id"], "ts", 3600).select("user_id", "session", "n")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, n, event_id, event_type AS stage, t AS sent, true AS kept FROM o WHERE n = 1
        UNION ALL SELECT o.user_id, o.n, o.event_id, o.event_type, CASE WHEN o.event_type <> r.stage OR o.t - r.sent >= 3600000000 THEN o.t ELSE r.sent END, o.event_type <> r.stage OR o.t - r.sent >= 3600000000 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
    SELECT user_id, event_id FROM r WHERE kept""")
def event_debounce(spark, sf_dir):
    """Events that change the stage or come an hour after the last one sent (STM-03 in batch)."""
    return windows.debounced(events(spark, sf_dir), ["user_id"], "ts", "event_type", 3600)


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def event_props(spark, sf_dir):
    """Typed fields of JSON properties (SRC-23, D13)."""
    p = F.from_json("props", "k int")
    return events(spark, sf_dir).select("event_type", p["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query(f"WITH {JOBS}, w AS (SELECT DISTINCT worker FROM job WHERE status = 'running' AND worker >= 12), q AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY updated, job_id) AS n FROM job WHERE status = 'queued' AND worker NOT IN (SELECT worker FROM w)) SELECT worker, job_id FROM q WHERE n = 1")
def fifo_claim(spark, sf_dir):
    """The oldest queued job of each free worker (WIN-22, WIN-23)."""
    j = jobs(spark, sf_dir)
    return windows.claim_first(j, j.where("status = 'running' and worker >= 12"), "worker", ["updated", "job_id"]).select("worker", "job_id")


@query(f"WITH {JOBS}, w AS (SELECT c_custkey % 20 AS worker, c_custkey AS owner, CASE WHEN c_acctbal > 5000 THEN ['HIGH', 'LOW'] ELSE ['LOW'] END AS operations FROM customer WHERE c_acctbal > 0) SELECT job_id, job.owner FROM job JOIN w ON job.worker = w.worker AND job.owner = w.owner WHERE status = 'queued' AND list_contains(operations, CASE WHEN price > 200000 THEN 'HIGH' ELSE 'LOW' END)")
def claimable_jobs(spark, sf_dir):
    """Queued jobs with a worker of their owner that can run them (JN-35, DT-08)."""
    c = table(spark, sf_dir, "customer")
    w = c.select((F.col("c_custkey") % 20).alias("worker_id"), F.col("c_custkey").alias("owner"), (F.col("c_acctbal") > 0).alias("enabled"), now().alias("heartbeat"), F.when(F.col("c_acctbal") > 5000, F.array(F.lit("HIGH"), F.lit("LOW"))).otherwise(F.array(F.lit("LOW"))).alias("operations"))
    j = jobs(spark, sf_dir).withColumnRenamed("worker", "assigned_worker_id").withColumn("operation", F.when(F.col("price") > 200000, "HIGH").otherwise("LOW"))
    return joins.claimable(j, w, now()).select("job_id", "owner")


@query(f"WITH {JOBS} SELECT job_id FROM job WHERE status = 'running' AND coalesce(heartbeat, updated) < {NOW} - INTERVAL 3600 SECOND")
def stale_jobs(spark, sf_dir):
    """Running jobs that went silent (DT-09)."""
    return selection.stale(jobs(spark, sf_dir), now(), 3600).select("job_id")


@query(f"WITH {JOBS}, r AS (SELECT job_id, owner, price > 250000 AS h, row_number() OVER (PARTITION BY owner, priority ORDER BY job_id) AS n, first_value(price > 250000) OVER (PARTITION BY owner, priority ORDER BY job_id) AS f FROM job) SELECT job_id, CASE WHEN n = 1 THEN 'created' WHEN h = f THEN 'repeated' ELSE 'conflict' END AS outcome FROM r")
def idempotent_submit(spark, sf_dir):
    """Repeated requests by key and hash (SRC-35, STM-09)."""
    r = jobs(spark, sf_dir).withColumn("request_hash", F.col("price") > 250000)
    return selection.idempotent(r, ["owner", "priority"], ["job_id"]).select("job_id", "outcome")


@query(f"WITH {JOBS} SELECT job_id FROM job WHERE owner = 77 OR (price > 490000)")
def visible_jobs(spark, sf_dir):
    """A reviewer's view: own jobs and baselines (PRJ-09, JN-37)."""
    from vellumite.functions.predicates import visible

    j = jobs(spark, sf_dir)
    return j.where(visible(F.col("owner"), F.col("price") > 490000, F.lit(77), F.lit("reviewer"))).select("job_id")


@query(f"WITH {JOBS}, a AS (SELECT c_custkey AS owner FROM customer WHERE c_mktsegment = 'MACHINERY') SELECT job_id FROM job WHERE owner IN (SELECT owner FROM a)")
def owned_jobs(spark, sf_dir):
    """A row policy as a semi join (JN-36)."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("owner"))
    return joins.owned_by(jobs(spark, sf_dir), c).select("job_id")


@query(f"WITH {JOBS}, t AS (SELECT * FROM job ORDER BY updated DESC, job_id DESC LIMIT 500) SELECT job_id FROM t WHERE owner % 2 = 0")
def newest_then_visible(spark, sf_dir):
    """The limit before the filter (SRT-08)."""
    return selection.newest_then_visible(jobs(spark, sf_dir), [F.desc("updated"), F.desc("job_id")], 500, F.col("owner") % 2 == 0).select("job_id")


@query(f"WITH {JOBS} SELECT job_id FROM job WHERE owner % 2 = 0 ORDER BY updated DESC, job_id DESC LIMIT 100")
def visible_then_newest(spark, sf_dir):
    """The filter before the limit (SRT-10)."""
    return selection.visible_then_newest(jobs(spark, sf_dir), [F.desc("updated"), F.desc("job_id")], 100, F.col("owner") % 2 == 0).select("job_id")


@query("SELECT event_id, event_type FROM events WHERE event_id > 1234 ORDER BY event_id LIMIT 500")
def events_after(spark, sf_dir):
    """The next page behind a key (SRT-09, STM-06)."""
    return selection.after(events(spark, sf_dir), "event_id", 1234).select("event_id", "event_type")


@query(f"WITH {JOBS} SELECT job_id FROM job WHERE updated < {NOW} - INTERVAL 24 HOUR AND status = 'succeeded'")
def expired_jobs(spark, sf_dir):
    """Finished jobs behind the retention (DT-06, DT-07)."""
    return selection.expired(jobs(spark, sf_dir), now(), 24, finished_only=True).select("job_id")


@query(f"WITH {JOBS}, r AS (SELECT job_id, job_id % 5 AS lease, job_id % 2 AS hash FROM job), j AS (SELECT job_id, status, job_id % 4 AS lease, job_id % 2 AS rh FROM job) SELECT r.job_id, CASE WHEN status = 'running' AND j.lease = r.lease THEN 'accepted' WHEN status = 'succeeded' AND j.lease = r.lease AND rh = hash THEN 'replayed' ELSE 'refused' END AS outcome FROM r JOIN j USING (job_id)")
def accepted_results(spark, sf_dir):
    """Results by lease and hash (STM-10, STM-11, STM-12)."""
    j = jobs(spark, sf_dir)
    r = j.select("job_id", (F.col("job_id") % 5).alias("lease"), (F.col("job_id") % 2).alias("hash"))
    return selection.accept_result(j.select("job_id", "status", (F.col("job_id") % 4).alias("lease"), (F.col("job_id") % 2).alias("result_hash")), r).select("job_id", "outcome")


@query(f"WITH {JOBS}, c AS (SELECT owner, priority, price, row_number() OVER (PARTITION BY owner, priority ORDER BY updated DESC, job_id DESC) AS n FROM job WHERE status <> 'queued'), b AS (SELECT owner, priority, max(price) AS price FROM job WHERE status = 'queued' GROUP BY ALL) SELECT owner, priority, price FROM c WHERE n = 1 UNION ALL SELECT owner, priority, price FROM b WHERE (owner, priority) NOT IN (SELECT (owner, priority) FROM c)")
def merged_glossary(spark, sf_dir):
    """Merge of duplicates on a compound key (ARR-12, ARR-13, STM-07)."""
    j = jobs(spark, sf_dir)
    base = j.where("status = 'queued'").groupBy("owner", "priority").agg(F.max("price").alias("price")).withColumn("updated", F.struct(now().alias("a"), F.lit(0).cast("long").alias("b")))
    ch = j.where("status <> 'queued'").select("owner", "priority", "price", F.struct(F.col("updated").alias("a"), F.col("job_id").alias("b")).alias("updated"))
    return selection.upsert(base, ch, ["owner", "priority"]).select("owner", "priority", "price")


@query("SELECT o_custkey AS owner, CAST(len(list(o_orderkey)) AS INTEGER) AS n, list_sort(list(o_orderkey))[1] AS first FROM orders GROUP BY o_custkey")
def jobs_with_artifacts(spark, sf_dir):
    """Parents with the array of their children (AGG-41, JN-38)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), "o_orderkey")
    p = o.select("owner").distinct()
    return joins.with_children(p, o, "owner", ["o_orderkey"], "items").select("owner", F.size("items").alias("n"), F.col("items")[0]["o_orderkey"].alias("first"))


@query("SELECT c_custkey AS job_id, least(86400, 600 + 30 * greatest(0, c_custkey % 400 - 100)) AS seconds FROM customer")
def job_limits(spark, sf_dir):
    """Seconds by pages (DT-05)."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), selection.time_limit(F.lit(600), F.col("c_custkey") % 400).alias("seconds"))


@query("SELECT c_custkey, sha256('{\"c_acctbal\":' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) || ',\"c_name\":\"' || c_name || '\"}') AS fingerprint FROM customer")
def fingerprints(spark, sf_dir):
    """Hash of canonical JSON (ARR-01, ARR-02)."""
    c = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.round(F.col("c_acctbal") * 100).cast("long"))
    return c.select("c_custkey", selection.fingerprint(["c_name", "c_acctbal"]).alias("fingerprint"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 10 THEN lower(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN ':' ELSE '' END END AS label FROM nation")
def whole_labels(spark, sf_dir):
    """Paragraphs that are one label of a glossary, with its translation (STR-59)."""
    from vellumite.operators import joins

    n = table(spark, sf_dir, "nation")
    paragraphs = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit(" "), "n_name", F.when(F.col("n_nationkey") % 2 == 0, " :").otherwise("")).alias("text"))
    glossary = n.where("n_nationkey < 10").select(F.col("n_name").alias("source"), F.lower("n_name").alias("target"))
    return joins.whole_labels(paragraphs, glossary).select("id", "label")


@query("SELECT l_orderkey AS table_id, l_linenumber AS row, string_agg(l_returnflag || l_suppkey, chr(10) ORDER BY l_suppkey, l_returnflag) AS text FROM (SELECT l_orderkey, l_linenumber, l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY ALL) GROUP BY ALL")
def refreshed_cells(spark, sf_dir):
    """Cells from the texts of their regions; regions that are gone are passed over (ARR-10)."""
    from vellumite.operators import joins

    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.min("l_returnflag").alias("f"))  # noqa: E741
    id = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_suppkey")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_suppkey", id.alias("id")))), lambda x: x["id"])
    tables = l.groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row")).agg(ids.alias("region_ids")).withColumn("column", F.lit(0))
    regions = l.where("l_suppkey % 3 <> 0").select(id.alias("id"), F.concat("f", F.col("l_suppkey").cast("string")).alias("text"))
    return joins.refreshed_cells(tables, regions).where("text <> ''").select("table_id", "row", "text")


@query(r"SELECT DISTINCT 1 AS table_id, trim(p_name) AS value FROM part WHERE false UNION ALL SELECT DISTINCT 1, p_brand || ' X' || p_size FROM part WHERE p_size > 25")
def product_terms(spark, sf_dir):
    """Product names of a column that its header and another column's mark as one (STR-51)."""
    from vellumite.operators import joins

    p = table(spark, sf_dir, "part")
    rows = p.select((F.col("p_partkey") + 1).alias("row"), F.array(F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, F.concat("p_brand", F.lit(" X"), F.col("p_size").cast("string"))).otherwise(F.lit("$12")), F.lit("X100")).alias("c"))
    head = spark.range(1).select(F.lit(0).cast("long").alias("row"), F.array(F.lit("SKU"), F.lit(" Item "), F.lit("Note")).alias("c"))
    cells = rows.unionByName(head).select(F.lit(1).alias("table_id"), "row", F.posexplode("c").alias("column", "text"))
    return joins.product_terms(cells)
