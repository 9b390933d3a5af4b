"""Queries over nested documents and whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumite.catalog import query, table
from vellumite.functions import integrity, predicates, text
from vellumite.operators import aggregates, joins, selection
from vellumite.plans import privacy, providers
from vellumite.sources import documents as nested


def content(spark, sf_dir):
    """Orders as documents of one page whose table has a header and a row for each line item."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    row = F.array(F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int").cast("string")))
    rows = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("cells")))).alias("r"))
    cells = F.concat(F.array(F.array(F.lit("Line"), F.lit("Flag"), F.lit("Quantity"))), F.transform("r", lambda x: x["cells"]))
    region = F.struct(F.lit("t1").alias("id"), F.lit("table").alias("kind"), F.array(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(50.0)).alias("bbox"), F.lit(None).cast("string").alias("text"), cells.alias("cells"))
    head = F.struct(F.lit("h1").alias("id"), F.lit("text").alias("kind"), F.array(F.lit(0.0), F.lit(60.0), F.lit(100.0), F.lit(70.0)).alias("bbox"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("text"), F.lit(None).cast("array<array<string>>").alias("cells"))
    unit = F.struct(F.lit("p1").alias("id"), F.lit(1).alias("number"), F.array(region, head).alias("regions"))
    return rows.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.array(unit).alias("units"))


@query("""SELECT l_returnflag AS value, 'Flag' AS column_header, count(*) AS n FROM lineitem GROUP BY l_returnflag UNION ALL SELECT CAST(l_linenumber AS VARCHAR), 'Line', count(*) FROM lineitem GROUP BY l_linenumber
    UNION ALL SELECT CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 'Quantity', count(*) FROM lineitem WHERE l_quantity > 25 GROUP BY l_quantity""")
def flattened_cells(spark, sf_dir):
    """Nested tables to one row a cell that is not empty, with its header (SRC-06, SRC-07)."""
    r = nested.text_regions(content(spark, sf_dir)).where("row > 0")
    return r.groupBy(F.col("text").alias("value"), "column_header").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT l_orderkey) AS documents, count(*) + count(*) + CAST(count(*) FILTER (l_quantity > 25) AS BIGINT) + 3 * count(DISTINCT l_orderkey) + count(DISTINCT l_orderkey) AS regions FROM lineitem")
def flattened_regions(spark, sf_dir):
    """All text regions and cells, headers too (SRC-07)."""
    return nested.text_regions(content(spark, sf_dir)).agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("regions"))


@query("WITH v AS (SELECT l_partkey AS k, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS rv, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'X' ELSE l_returnflag END AS pv FROM (SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)) SELECT k, count(*) FILTER (rv IS NOT DISTINCT FROM pv) AS cell_tp, count(*) FILTER (rv IS DISTINCT FROM pv) AS cell_fp, count(*) FILTER (rv IS DISTINCT FROM pv) AS cell_fn FROM v GROUP BY k")
def cell_scores(spark, sf_dir):
    """Cells at one place with one value, null apart from empty (AGG-04, JN-02)."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))  # noqa: E741
    n, third = F.col("l_linenumber"), F.col("l_linenumber") % 3 == 0
    at = [F.col("l_partkey").alias("k"), F.struct("l_orderkey", "l_suppkey").alias("row"), n.alias("column")]
    ref = l.select(*at, F.when(~third, F.col("f")).alias("value"))
    pred = l.select(*at, F.when(~third, F.when(n % 2 == 0, "X").otherwise(F.col("f"))).alias("value"))
    return aggregates.slot_counts(ref, pred, ["k"])


@query("""WITH r AS (SELECT l_orderkey AS id, list(struct_pack(t := l_returnflag, s := l_discount * 10, v := l_linestatus, m := l_linenumber % 2)) AS c FROM lineitem GROUP BY l_orderkey),
    x AS (SELECT id, len([y FOR y IN c IF y.s >= 0.85]) AS n, list_distinct([y.t FOR y IN c IF y.s >= 0.85]) AS t, list_distinct([y.m FOR y IN c IF y.s >= 0.85]) AS m FROM r)
    SELECT id, n > 0 AND len(m) >= 2 AND len(t) = 1 AND t[1] = 'A' AS alike FROM x""")
def readings_alike(spark, sf_dir):
    """Lines that two models read alike (AGG-37)."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    reading = F.struct(F.col("l_returnflag").alias("text"), (F.col("l_discount") * 10).alias("score"), F.col("l_linestatus").alias("variant"), (F.col("l_linenumber") % 2).cast("string").alias("model"))
    return l.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(reading).alias("c")).select("id", aggregates.read_alike(F.lit("A"), F.col("c")).alias("alike"))


@query("WITH r AS (SELECT l_orderkey AS id, count(DISTINCT l_returnflag) AS forms FROM lineitem GROUP BY l_orderkey) SELECT forms > 1 AS disagree, count(*) AS n FROM r GROUP BY ALL")
def reading_consensus(spark, sf_dir):
    """Readings that agree or not (AGG-34)."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    reading = F.struct(F.col("l_returnflag").alias("text"), (F.col("l_discount") * 10).alias("score"), F.col("l_linestatus").alias("variant"), (F.col("l_linenumber") % 2).cast("string").alias("model"))
    c = l.groupBy("l_orderkey").agg(F.collect_list(reading).alias("c")).select(aggregates.consensus(F.col("c")).alias("s"))
    return c.select((F.col("s.reason") == "character_disagreement").alias("disagree")).groupBy("disagree").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT l_orderkey AS table_id, count(*) AS rows FROM lineitem GROUP BY l_orderkey), e AS (SELECT l_orderkey AS table_id, count(*) FILTER (l_quantity <= 25) / count(*) AS empty FROM lineitem GROUP BY l_orderkey) SELECT table_id, empty <= 0.7 AND rows > 2 AS real FROM c JOIN e USING (table_id)")
def real_tables(spark, sf_dir):
    """Tables that are none: too empty, or a pair of number rows (AGG-27)."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    l = l.withColumn("row", n)  # noqa: E741  before a line becomes two cells
    cells = l.select(F.col("l_orderkey").alias("table_id"), "row", F.explode(F.array(F.struct(F.lit(0).alias("column"), F.col("l_linenumber").cast("string").alias("text")), F.struct(F.lit(1).alias("column"), F.when(F.col("l_quantity") > 25, F.lit("x")).alias("text")))).alias("c")).select("table_id", "row", "c.*")
    return aggregates.real_tables(cells, ["Figure"])


@query("SELECT o_orderpriority AS category, o_custkey AS value, min(o_orderkey % 4) AS best FROM orders GROUP BY ALL")
def best_methods(spark, sf_dir):
    """The most telling method of each value (SRT-03)."""
    o = table(spark, sf_dir, "orders")
    m = F.element_at(F.array(*map(F.lit, predicates.METHODS[:4])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    f = o.select("o_orderpriority", F.col("o_custkey").alias("value"), F.lit("Names").alias("category"), m.alias("method"))
    b = selection.best_methods(f, ["o_orderpriority"])
    return b.select(F.col("o_orderpriority").alias("category"), "value", (F.array_position(F.array(*map(F.lit, predicates.METHODS)), F.col("method")) - 1).alias("best"))


@query("WITH i AS (SELECT DISTINCT o_custkey % 30 AS page, CAST(o_orderkey % 50 AS DOUBLE) / 100 AS x, CAST(o_orderkey % 70 AS DOUBLE) / 100 AS y, CASE WHEN o_orderstatus = 'F' THEN 'masked' ELSE 'suggested' END AS state FROM orders) SELECT page, x, y, state FROM i ORDER BY state <> 'suggested', page, y, x LIMIT 200")
def review_queue(spark, sf_dir):
    """Distinct items, suggested first, two hundred at most (SRT-02, JN-24)."""
    o = table(spark, sf_dir, "orders")
    i = o.select((F.col("o_custkey") % 30).alias("page"), ((F.col("o_orderkey") % 50).cast("double") / 100).alias("x"), ((F.col("o_orderkey") % 70).cast("double") / 100).alias("y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"), F.when(F.col("o_orderstatus") == "F", "masked").otherwise("suggested").alias("state"), F.lit("r").alias("reason"), F.lit("c").alias("category"))
    return selection.queue(i).select("page", "x", "y", "state")


@query()
def detected_documents(spark, sf_dir):
    """All layers of detection over texts, with an offline provider (UDF-01 to UDF-05)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("r1").alias("region_id"), "text")
    pairs = spark.createDataFrame([], "doc_id string, region_id string, label string, value string, kind string")
    decisions = spark.createDataFrame([("API key", "Identifiers")], "label string, category string")
    names = spark.createDataFrame([("Anna Moor",)], "name string")
    found, _ = privacy.detect_document(d, pairs, decisions, names, predicates.CATEGORIES)
    return found.select("doc_id", "value", "category", "method")


@query("SELECT true AS valid, count(*) AS n FROM conversations")
def model_answers(spark, sf_dir):
    """Answers of an offline provider to distinct turns, checked against their texts (STR-14, UDF-20)."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("region_id"), "text")
    a = providers.asked_once(c, "text", providers.offline).select("region_id", "answer")
    return privacy.valid_proposals(a, c, predicates.CATEGORIES).groupBy("valid").agg(F.count("*").alias("n"))


@query("""SELECT detected, count(*) AS n FROM (SELECT CASE item_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'by_words' ELSE 'missed' END AS detected
    FROM benchmark WHERE len(regexp_extract_all(text, '[^ ]+')) > 1) GROUP BY detected""")
def expected_values(spark, sf_dir):
    """Expected values against what was found in their item, by kind of match (JN-32, STR-28, STR-29).

    Found are the text in capitals, the text where more is expected, its words one by one, and nothing."""
    b = table(spark, sf_dir, "benchmark").where(F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))) > 1)
    kind = F.col("item_id") % 4
    expected = b.select(F.col("item_id").alias("doc"), F.lit("Names").alias("category"), F.when(kind == 1, F.concat("text", F.lit(" and more"))).otherwise(F.col("text")).alias("value"))
    words = b.where(kind == 2).select(F.col("item_id").alias("doc"), F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("value")).where("value <> ''")
    found = b.where(kind < 2).select(F.col("item_id").alias("doc"), F.when(kind == 0, F.upper("text")).otherwise(F.col("text")).alias("value")).union(words)
    return joins.detected_as(expected, found).groupBy("detected").agg(F.count("*").alias("n"))


@query()
def text_segments(spark, sf_dir):
    """Lossless segments of texts outside literals (STR-46)."""
    d = table(spark, sf_dir, "documents").select("doc_id", integrity.bounded_segments("text").alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.array_max(F.transform("s", F.length)).alias("longest"))


@query()
def restored_texts(spark, sf_dir):
    """Literals to tokens and back (STR-33 to STR-37)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", integrity.protected("text").alias("p"))
    return c.select("conv_id", "turn", F.size("p.tokens").alias("tokens"), (integrity.restored(F.col("p.protected"), F.col("p.tokens")) == F.col("text")).alias("same"))


@query()
def street_addresses(spark, sf_dir):
    """Street patterns of four families (STR-54)."""
    from vellumite.functions import pii

    return table(spark, sf_dir, "documents").select("doc_id", F.explode(pii.street_addresses(F.col("text"))).alias("address"))


@query()
def turn_errors(spark, sf_dir):
    """Word errors by kind of each reply against the turn before (STR-03, AGG-05)."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations")
    p = c.select("conv_id", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("a"), F.col("text").alias("b")).where("a is not null")
    e = p.select("conv_id", text.word_edit_counts("a", "b").alias("e"), F.size(F.split(F.trim("a"), r"\s+")).alias("reference_units")).select("conv_id", "e.*", "reference_units")
    return aggregates.edits(e, ["conv_id"])
