"""Queries over documents, conversations, pages, labels and the benchmark."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.catalog import EMAIL, query, table
from vellumite.functions import integrity, pii, predicates, text
from vellumite.operators import aggregates, joins, windows


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query()
def pii_findings(spark, sf_dir):
    """All rule-based findings of every text with their spans (STR-06 to STR-16)."""
    found = documents(spark, sf_dir).select("doc_id", F.explode(pii.detect(F.col("text"))).alias("f"))
    return found.select("doc_id", "f.value", "f.category", "f.method", F.size("f.spans").alias("spans"))


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{EMAIL}', '[REDACTED]', 'g')) AS masked_sha256 FROM documents")
def masked_emails(spark, sf_dir):
    """Texts with their addresses masked (STR-17)."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.regexp_replace("text", EMAIL, "[REDACTED]"), 256).alias("masked_sha256"))


@query()
def masked_findings(spark, sf_dir):
    """Every finding masked at token borders, the longest first (STR-17, AGG-17)."""
    d = documents(spark, sf_dir).withColumn("values", pii.literal_values(pii.detect(F.col("text"))))
    return d.select("doc_id", F.size("values").alias("n"), F.sha2(pii.mask("text", "values"), 256).alias("masked_sha256"))


@query(f"WITH e AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{EMAIL}')) AS value FROM documents), f AS (SELECT lang, lower(value) AS k, min(doc_id) AS first FROM e GROUP BY ALL) SELECT e.lang, e.value, 'Email ' || dense_rank() OVER (PARTITION BY e.lang ORDER BY f.first, f.k) AS label FROM (SELECT DISTINCT lang, value FROM e) e JOIN f ON e.lang = f.lang AND lower(e.value) = f.k")
def pseudonym_emails(spark, sf_dir):
    """Numbered placeholders in order of first appearance (WIN-19)."""
    found = documents(spark, sf_dir).select("doc_id", "lang", F.explode(F.regexp_extract_all("text", F.lit(f"({EMAIL})"))).alias("value")).withColumn("category", F.lit("Email addresses"))
    return windows.pseudonyms(found, ["lang"], "doc_id").select("lang", "value", "label")


@query(r"""WITH l AS (SELECT lang, trim(regexp_replace(trim(unnest(string_split(text, chr(10)))), '[:：]+$', '')) AS t FROM documents),
    w AS (SELECT lang, t, [x FOR x IN string_split_regex(t, '\s+') IF x <> ''] AS ws FROM l)
    SELECT lang, count(*) AS lines, count(*) FILTER (length(t) BETWEEN 1 AND 48 AND len(ws) <= 6 AND regexp_matches(t, '\p{L}') AND NOT regexp_matches(t, '\p{Nd}') AND NOT (regexp_matches(t, '[!?]$') OR (ends_with(t, '.') AND length(ws[-1]) > 4))
        AND NOT regexp_matches(t, '@|://|/') AND len(regexp_extract_all(t, '\(')) = len(regexp_extract_all(t, '\)')) AND len(regexp_extract_all(t, '\[')) = len(regexp_extract_all(t, '\]'))) AS labels FROM w GROUP BY lang""")
def label_like_lines(spark, sf_dir):
    """Lines that look like field labels (PRJ-13)."""
    lines = documents(spark, sf_dir).select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("lines"), F.count_if(predicates.label_like(F.col("line"))).alias("labels"))


@query()
def field_pairs(spark, sf_dir):
    """'Label: value' pairs of lines and segments (JN-19, STR-20)."""
    return joins.line_fields(documents(spark, sf_dir).unionByName(documents(spark, sf_dir).withColumn("text", F.concat_ws("\n", F.concat(F.lit("Source: "), "source", F.lit("   Language: "), "lang"), F.lit("API key: none (yet)")))), "doc_id")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, [trim(x) FOR x IN string_split_regex(line, '\\||\t| {3,}') IF trim(x) <> ''] AS p FROM l) SELECT doc_id, CAST(sum(len(p)) AS BIGINT) AS segments, CAST(max(len(p)) AS INTEGER) AS widest FROM s GROUP BY doc_id""".replace("\\\\", "\\"))
def line_segments(spark, sf_dir):
    """Segments of lines between pipes and wide gaps (STR-20)."""
    s = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", text.segments(F.col("line")).alias("p"))
    return s.groupBy("doc_id").agg(F.sum(F.size("p").cast("long")).alias("segments"), F.max(F.size("p")).alias("widest"))


@query()
def turn_integrity(spark, sf_dir):
    """The first rule that each reply breaks against the turn before it (STR-42, SET-04)."""
    c = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    pairs = c.select("conv_id", "turn", F.lag("text").over(w).alias("source"), F.col("text").alias("target")).where("source is not null")
    return pairs.select("conv_id", "turn", integrity.fault("source", "target").alias("fault"))


@query()
def literal_differences(spark, sf_dir):
    """Literals that a reply lost or gained (SET-03, SET-04, AGG-19)."""
    c = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    d = c.withColumn("inv", integrity.literal_inventory("text")).select("conv_id", "turn", F.lag("inv").over(w).alias("a"), F.col("inv").alias("b")).where("a is not null")
    return d.select("conv_id", "turn", F.size(integrity.multiset_difference(F.col("a"), F.col("b"))).alias("lost"), F.size(integrity.multiset_difference(F.col("b"), F.col("a"))).alias("gained"))


ASCII = r"regexp_replace({0}, '[^\x01-\x7F]', '?', 'g')"


@query(f"""WITH p AS (SELECT conv_id, turn, {ASCII.format('text')} AS b, {ASCII.format('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS a FROM conversations),
    n AS (SELECT conv_id, trim(regexp_replace(a, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS b FROM p WHERE a IS NOT NULL)
    SELECT conv_id, CAST(sum(levenshtein(a, b)) AS BIGINT) AS errors, CAST(sum(length(a)) AS BIGINT) AS reference, round(sum(levenshtein(a, b)) / sum(length(a)), 6) AS cer FROM n GROUP BY conv_id""")
def cer_turns(spark, sf_dir):
    """Character errors of each conversation's turns against the turn before (AGG-02, AGG-03, STR-02)."""
    c = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    fold = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\x01-\x7F]", "?"), r"\s+", " "))
    p = c.select("conv_id", F.lag("text").over(w).alias("a"), F.col("text").alias("b")).where("a is not null").select("conv_id", fold(F.col("a")).alias("a"), fold(F.col("b")).alias("b"))
    s = p.groupBy("conv_id").agg(F.sum(text.edit_distance(F.col("a"), F.col("b")).cast("long")).alias("errors"), F.sum(F.length("a").cast("long")).alias("reference"), F.count("*").alias("pages"))
    return s.select("conv_id", "errors", "reference", F.round(aggregates.error_rate(F.col("errors"), F.col("reference"), F.col("pages")), 6).alias("cer"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY lang, substr(text, 1, 100)")
def dedup_keep_first(spark, sf_dir):
    """The first document of each language and beginning (WIN-16)."""
    return windows.keep_first(documents(spark, sf_dir), ["lang"], ["doc_id"]).select("doc_id")


@query(r"SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(regexp_replace(d.text, '\s+', '', 'g')), lower(regexp_replace(b.text, '\s+', '', 'g'))) WHERE regexp_replace(b.text, '\s+', '', 'g') <> ''")
def leak_check(spark, sf_dir):
    """Benchmark passages still contained in a text, blanks and case aside (JN-32)."""
    key = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    b = table(spark, sf_dir, "benchmark").where(key(F.col("text")) != "").select("item_id", key(F.col("text")).alias("needle"))
    d = documents(spark, sf_dir).select("doc_id", key(F.col("text")).alias("hay"))
    return joins.containing(d.select(F.col("doc_id").alias("id"), F.col("hay").alias("body")), b.select(F.col("item_id").alias("value_id"), "needle")).select(F.col("id").alias("doc_id"), F.col("value_id").alias("item_id"))


@query(r"""WITH c AS (SELECT lang, [lower(x) FOR x IN regexp_extract_all(unnest(string_split_regex(text, '\S*[@\d]\S*|\S*://\S*')), '\p{L}[\p{L}''’-]*')] AS w FROM documents),
    one AS (SELECT lang, x AS term, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM c) WHERE length(x) >= 6 GROUP BY ALL HAVING count(*) >= 3),
    p AS (SELECT lang, unnest(list_zip(w[1:len(w) - 1], w[2:len(w)])) AS p FROM c WHERE len(w) > 1),
    two AS (SELECT lang, p[1] || ' ' || p[2] AS term, count(*) AS n FROM p WHERE length(p[1]) > 2 AND length(p[2]) > 2 GROUP BY ALL HAVING count(*) >= 2)
    SELECT lang, term, n, 1 AS words FROM one UNION ALL SELECT lang, term, n, 2 FROM two""")
def glossary_terms(spark, sf_dir):
    """Recurring words and word pairs by language (AGG-28)."""
    return aggregates.term_counts(documents(spark, sf_dir), ["lang"], [])


@query("SELECT source, doc_id, CAST(before AS BIGINT) AS before FROM (SELECT source, doc_id, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 1800")
def document_openings(spark, sf_dir):
    """The first texts of each source up to a length (SRT-06)."""
    from vellumite.operators.selection import opening

    return opening(documents(spark, sf_dir), ["source"], ["doc_id"]).select("source", "doc_id", "before")


@query(r"SELECT lang, CAST(sum(len(regexp_extract_all(text, '\p{Latin}'))) AS BIGINT) AS latin, CAST(sum(len(regexp_extract_all(text, '\p{Han}'))) AS BIGINT) AS han, CAST(sum(len(regexp_extract_all(text, '\p{Cyrillic}'))) AS BIGINT) AS cyrillic FROM documents GROUP BY lang")
def script_letters(spark, sf_dir):
    """Letters by script and language (STR-30, STR-62)."""
    c = documents(spark, sf_dir).select("lang", text.script_counts(F.col("text")).alias("m"))
    n = lambda s: F.sum(F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0)).cast("long"))
    return c.groupBy("lang").agg(n("Latin").alias("latin"), n("Han").alias("han"), n("Cyrillic").alias("cyrillic"))


@query(r"SELECT doc_id, sha256(regexp_replace(lower(text), '\s+', '', 'g')) AS key FROM documents")
def compact_keys(spark, sf_dir):
    """Texts without blanks and case (STR-05, STR-24)."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.lower(text.compact(F.col("text"))), 256).alias("key"))


@query()
def normalised_texts(spark, sf_dir):
    """NFKC with single spaces (STR-01)."""
    return documents(spark, sf_dir).select("doc_id", F.length(text.normalize(F.col("text"))).alias("n"), F.sha2(text.normalize(F.col("text")), 256).alias("key"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<t[dh][ >]')) AS INTEGER) AS cells, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS INTEGER) AS links FROM pages")
def page_facts(spark, sf_dir):
    """Title, cells and links of raw pages (SRC-18)."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<t[dh][ >]")).alias("cells"), F.regexp_count("html", F.lit("<a [^>]*href=")).alias("links"))


@query("""WITH o AS (SELECT o_custkey AS page_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS row, o_orderkey, o_orderstatus FROM orders)
    SELECT DISTINCT page_id, 0 AS table_id, 0 AS row, 0 AS "column", 'Order' AS text, true AS header, false AS spanned FROM o UNION ALL SELECT DISTINCT page_id, 0, 0, 1, 'Status & more', true, true FROM o
    UNION ALL SELECT page_id, 0, row, 0, CAST(o_orderkey AS VARCHAR), false, false FROM o UNION ALL SELECT page_id, 0, row, 1, o_orderstatus, false, false FROM o""")
def html_cells(spark, sf_dir):
    """Cells of the tables of pages that list each customer's orders (SRC-18)."""
    from vellumite.sources.html import table_cells

    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("long").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    rows = F.array_join(F.transform("o", lambda x: F.concat(F.lit("<tr><td> "), x["o_orderkey"].cast("string"), F.lit("</td><td><b>"), x["o_orderstatus"], F.lit("</b>\n</td></tr>"))), "")
    listed = o.select("page_id", F.concat(F.lit('<p>x</p><table><tr><th>Order</th><th colspan="2">Status &amp; more</th></tr>'), rows, F.lit("</table>")).alias("html"))
    return table_cells(listed)


JUDGED = "judged AS (SELECT doc_id, lang, source, quality, CASE WHEN text LIKE '%$$$%' OR text LIKE '%!!%' OR text LIKE '% | %' THEN 0 ELSE 1 END AS guess FROM documents JOIN labels USING (doc_id))"


def judged(spark, sf_dir):
    d = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    t = F.col("text")
    return d.select("doc_id", "lang", "source", "quality", F.when(t.contains("$$$") | t.contains("!!") | t.contains(" | "), 0).otherwise(1).alias("guess"))


@query(f"""WITH {JUDGED}, c AS (SELECT lang, count(*) FILTER (quality = 0 AND guess = 0) AS tp, count(*) FILTER (quality = 1 AND guess = 0) AS fp, count(*) FILTER (quality = 0 AND guess = 1) AS fn FROM judged GROUP BY lang)
    SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def prf_by_lang(spark, sf_dir):
    """Precision, recall and F1, null where undefined (AGG-01, AGG-07)."""
    j = judged(spark, sf_dir)
    q, g = F.col("quality"), F.col("guess")
    c = j.groupBy("lang").agg(F.count_if((q == 0) & (g == 0)).alias("tp"), F.count_if((q == 1) & (g == 0)).alias("fp"), F.count_if((q == 0) & (g == 1)).alias("fn"))
    return c.select("lang", "tp", "fp", "fn", *(F.round(v, 6).alias(k) for k, v in aggregates.prf(F.col("tp"), F.col("fp"), F.col("fn")).items()))


@query(f"""WITH {JUDGED}, c AS (SELECT source, count(*) FILTER (quality = 0 AND guess = 0) AS tp, count(*) FILTER (quality = 1 AND guess = 0) AS fp, count(*) FILTER (quality = 0 AND guess = 1) AS fn FROM judged GROUP BY source),
    r AS (SELECT source, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM c)
    SELECT source, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r""")
def prf_filled_by_source(spark, sf_dir):
    """The same by the convention of filled rates (JN-34, SET-01)."""
    j = judged(spark, sf_dir)
    q, g = F.col("quality"), F.col("guess")
    c = j.groupBy("source").agg(F.count_if((q == 0) & (g == 0)).alias("tp"), F.count_if((q == 1) & (g == 0)).alias("fp"), F.count_if((q == 0) & (g == 1)).alias("fn"))
    return c.select("source", *(F.round(v, 6).alias(k) for k, v in aggregates.prf_filled(F.col("tp"), F.col("fp"), F.col("fn")).items()))


@query(f"WITH {JUDGED}, b AS (SELECT *, CAST(guess = 0 AS INTEGER) AS f FROM judged WHERE quality = 0) SELECT 'lang' AS dimension, lang AS key, CAST(sum(f) AS BIGINT) AS found, count(*) AS total, round(sum(f) / count(*), 3) AS recall FROM b GROUP BY lang UNION ALL SELECT 'source', source, CAST(sum(f) AS BIGINT), count(*), round(sum(f) / count(*), 3) FROM b GROUP BY source")
def grouping_sets_recall(spark, sf_dir):
    """Recall by independent groupings (AGG-09)."""
    return aggregates.by_each(judged(spark, sf_dir).where("quality = 0"), ["lang", "source"], F.col("guess") == 0)


@query(f"WITH {JUDGED}, g AS (SELECT lang, source FROM judged WHERE quality = 0 GROUP BY ALL), p AS (SELECT lang, source FROM judged WHERE guess = 0 GROUP BY ALL) SELECT (SELECT count(*) FROM (FROM g INTERSECT FROM p)) AS tp, (SELECT count(*) FROM (FROM p EXCEPT FROM g)) AS fp, (SELECT count(*) FROM (FROM g EXCEPT FROM p)) AS fn")
def set_scores(spark, sf_dir):
    """Scores over distinct keys (JN-33, SET-01)."""
    j = judged(spark, sf_dir)
    return joins.set_scores(j.where("quality = 0"), j.where("guess = 0"), ["lang", "source"])


@query(f"WITH {JUDGED} , n AS (SELECT *, row_number() OVER (PARTITION BY lang, guess <> quality ORDER BY doc_id) AS n FROM judged) SELECT doc_id, guess <> quality AS bad FROM n WHERE (guess = quality AND n <= 3) OR (guess <> quality AND n = 1)")
def spot_checks(spark, sf_dir):
    """Some good rows and the first bad one (SRT-12)."""
    from vellumite.operators.selection import spot_checks as pick

    return pick(judged(spark, sf_dir), ["lang"], F.col("guess") != F.col("quality"), ["doc_id"], 3).select("doc_id", "bad")


@query()
def context_by_text(spark, sf_dir):
    """Texts of turns that have one context only (JN-26)."""
    c = table(spark, sf_dir, "conversations").select(text.collapse_key(F.col("text")).alias("key"), F.concat_ws("/", "role", F.col("turn").cast("string")).alias("context"))
    return joins.unique_context(c, c.where("context like 'system%'"))
