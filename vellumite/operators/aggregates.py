"""Scores, pooled counts, telemetry, votes and term counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text


def ratio(n: Column, d: Column) -> Column:
    """Null where the divisor is 0 or null."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1, null where undefined."""
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def prf_filled(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """The same by the convention that nothing expected and nothing found is perfect."""
    p = F.coalesce(ratio(tp, tp + fp), F.when(tp + fn == 0, 1.0).otherwise(0.0))
    r = F.coalesce(ratio(tp, tp + fn), F.lit(1.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0))}


def error_rate(errors: Column, reference: Column, pages: Column) -> Column:
    """Errors by reference length; 0 for an empty reference without errors, null for one with errors or without pages."""
    return F.when(reference > 0, ratio(errors, reference)).when((pages > 0) & (errors == 0), 0.0)


def pooled(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Micro metrics from summed counts of text, tables, figures and cells. Missing counts are 0."""
    names = ["text_pages", "character_errors", "reference_characters", "word_errors", "reference_words", "cell_tp", "cell_fp", "cell_fn", "tables_tp", "tables_fp", "tables_fn", "tables_iou_sum", "table_dimensions_correct", "figures_tp", "figures_fp", "figures_fn", "figures_iou_sum"]
    have = set(counts.columns)
    sums = counts.groupBy(*(keys or [])).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) if n in have else F.lit(0).alias(n) for n in names))
    c = F.col
    out = {
        "cer": error_rate(c("character_errors"), c("reference_characters"), c("text_pages")), "wer": error_rate(c("word_errors"), c("reference_words"), c("text_pages")),
        "table_dimensions_recall": ratio(c("table_dimensions_correct"), c("tables_tp") + c("tables_fn")),
    }
    for task in ("cell", "tables", "figures"):
        out |= {f"{task}_{k}": v for k, v in prf(c(f"{task}_tp"), c(f"{task}_fp"), c(f"{task}_fn")).items()}
    out |= {f"{task}_mean_iou": ratio(c(f"{task}_iou_sum"), c(f"{task}_tp")) for task in ("tables", "figures")}
    return sums.select(*(keys or []), *names, *(v.alias(k) for k, v in out.items()))


def table_slots(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells(keys, cells array<array<string>>) to a row a slot: row, column, value normalised, null kept apart from empty."""
    rows = cells.select(*keys, F.posexplode("cells").alias("row", "r"))
    return rows.select(*keys, "row", F.posexplode("r").alias("column", "v")).select(*keys, "row", "column", text.normalize(F.col("v")).alias("value"))


def slot_counts(reference: DataFrame, prediction: DataFrame, keys: list[str]) -> DataFrame:
    """cell_tp, cell_fp, cell_fn of slots at one place with one value (null equals null)."""
    at = [*keys, "row", "column"]
    r = reference.select(*at, F.col("value").alias("rv"), F.lit(True).alias("in_r"))
    p = prediction.select(*at, F.col("value").alias("pv"), F.lit(True).alias("in_p"))
    j = r.join(p, at, "full")
    right = F.col("in_r") & F.col("in_p") & F.col("rv").eqNullSafe(F.col("pv"))
    ok = F.coalesce(right, F.lit(False))
    return j.groupBy(*keys).agg(F.count_if(ok).alias("cell_tp"), F.count_if(F.col("in_p").isNotNull() & ~ok).alias("cell_fp"), F.count_if(F.col("in_r").isNotNull() & ~ok).alias("cell_fn"))


def edits(items: DataFrame, keys: list[str]) -> DataFrame:
    """Summed substitutions, insertions and deletions with their rate; null for edits without a reference."""
    s = items.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("reference_units", "substitutions", "insertions", "deletions")))
    all_edits = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    return s.withColumn("edits", all_edits).withColumn("rate", F.when(F.col("reference_units") > 0, ratio(F.col("edits"), F.col("reference_units"))).when(F.col("edits") == 0, 0.0))


def by_each(df: DataFrame, dimensions: list[str], found: Column) -> DataFrame:
    """Independent groupings side by side: dimension, key, found, total, recall in three places."""
    sets = ", ".join(f"(`{d}`)" for d in dimensions)
    df = df.withColumn("_found", found.cast("int"))
    name = "_t" + str(abs(hash(tuple(dimensions))) % 10**8)
    df.createOrReplaceTempView(name)
    which = "CASE " + " ".join(f"WHEN grouping(`{d}`) = 0 THEN '{d}'" for d in dimensions) + " END"
    key = "coalesce(" + ", ".join(f"CASE WHEN grouping(`{d}`) = 0 THEN cast(`{d}` AS string) END" for d in dimensions) + ")"
    return df.sparkSession.sql(f"SELECT {which} AS dimension, {key} AS key, sum(_found) AS found, count(*) AS total, round(sum(_found) / count(*), 3) AS recall FROM {name} GROUP BY GROUPING SETS ({sets})")


def rate3(n: Column, d: Column) -> Column:
    return F.bround(ratio(n, d), 3)


def exact_rank(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles exactly: percentile_disc over each group."""
    aggs = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").alias(name) for name, p in ps.items()]
    return df.groupBy(*keys).agg(*aggs)


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sorted[n // 2]: by counting, so that no group is collected."""
    w = W.partitionBy(*keys).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    return ranked.where(F.col("_i") == F.floor(F.col("_n") / 2)).select(*keys, F.col(value).alias("median"))


def interpolated_median(df: DataFrame, keys: list[str], value: str, default: float = 10.0) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.expr(f"percentile(`{value}`, 0.5)"), F.lit(default)).alias("median"))


def telemetry(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: calls, seconds, nearest-rank p50 and p95, tokens, decode rate, retries, validation failures."""
    done = F.col("event") == "transport_completed"
    s = F.when(done, F.coalesce("seconds", F.lit(0.0)))
    total = lambda c, scale=1.0: F.coalesce(F.sum(F.when(done, F.col(c)) / scale), F.lit(0.0))
    out = events.withColumn("_s", s).groupBy(*keys).agg(
        F.count_if(done).alias("transport_calls"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("http_seconds_sum"), F.avg("_s").alias("mean_http_seconds"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _s)").alias("p50_http_seconds"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY _s)").alias("p95_http_seconds"),
        total("prompt_eval_count").cast("long").alias("prompt_tokens"), total("eval_count").cast("long").alias("output_tokens"), total("eval_duration", 1e9).alias("decode_seconds"), total("prompt_eval_duration", 1e9).alias("prefill_seconds"), total("load_duration", 1e9).alias("load_seconds"),
        F.count_if((F.col("event") == "request_started") & (F.coalesce("attempt", "segment_attempt", F.lit(1)) > 1)).alias("retry_starts"), F.count_if(F.col("event") == "validation_failed").alias("validation_failures"),
    )
    return out.withColumn("decode_tokens_per_second", ratio(F.col("output_tokens"), F.col("decode_seconds"))).withColumn("output_tokens_per_http_second", ratio(F.col("output_tokens"), F.col("http_seconds_sum")))


def stage_audit(spans: DataFrame) -> DataFrame:
    """Seconds by document and stage, and over all documents (document null)."""
    return spans.rollup("stage", "document").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("spans")).where("stage is not null")


def measured_transport(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Client and server seconds; the share of the server only where both were measured."""
    both = F.col("client_seconds").isNotNull() & F.col("server_seconds").isNotNull()
    return rows.groupBy(*keys).agg(F.sum("client_seconds").alias("client_seconds"), F.sum("server_seconds").alias("server_seconds"), F.count_if(both).alias("measured"), ratio(F.sum(F.when(both, F.col("server_seconds"))), F.sum(F.when(both, F.col("client_seconds")))).alias("server_share"))


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*by)).alias("r")).select("r.*")


def token_recall(gold: Column, actual: Column) -> Column:
    """Share of the gold tokens (array) that the actual ones cover, counting each as often as it stands."""
    distinct = F.array_distinct(gold)
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    hit = F.aggregate(distinct, F.lit(0), lambda acc, x: acc + F.least(count(gold, x), count(actual, x)))
    return ratio(hit, F.size(gold))


def value_counts(source: DataFrame, output: DataFrame, values: DataFrame) -> DataFrame:
    """value, source_count, output_count, status of protected values; texts (page, text) with line wraps between words."""
    boundary = F.when(F.col("value").rlike(r"^[\x00-\x7F]*$"), F.lit("[A-Za-z0-9_]")).otherwise(F.lit(r"[\p{L}\p{N}_]"))
    literal = F.regexp_replace(F.regexp_replace("value", r"([\\.\[\]{}()*+?^$|/-])", r"\\$1"), r"\s+", r"\\s+")
    pattern = F.concat(F.lit("(?<!"), boundary, F.lit(")"), literal, F.lit("(?!"), boundary, F.lit(")"))
    vs = values.select("value").where("trim(value) <> ''").distinct().withColumn("pattern", pattern)

    # Spark nests its loops here, and broadcasts the values only below its own size threshold; beyond it both sides are dealt out
    def counted(texts, name):
        return texts.select("text").join(vs, F.regexp_count("text", F.col("pattern")) > 0).groupBy("value").agg(F.sum(F.regexp_count("text", F.col("pattern"))).alias(name))

    out = vs.select("value").join(counted(source, "source_count"), "value", "left").join(counted(output, "output_count"), "value", "left").na.fill(0)
    return out.withColumn("status", F.when(F.col("source_count") == 0, "not_found_in_source").when(F.col("source_count") == F.col("output_count"), "match").otherwise("count_mismatch"))


def email_counts(source: DataFrame, output: DataFrame) -> DataFrame:
    """Full outer comparison of e-mail addresses; a hyphen at a line's end belongs to the address."""
    pattern = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"

    def counted(t, name):
        body = F.regexp_replace("text", r"(?<=-)\r?\n[ \t]*(?=[A-Za-z0-9])", "")
        return t.select(F.explode(F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).alias("value")).groupBy("value").agg(F.count("*").alias(name))

    out = counted(source, "source_count").join(counted(output, "output_count"), "value", "full").na.fill(0)
    return out.withColumn("status", F.when(F.col("source_count") == F.col("output_count"), "match").otherwise("count_mismatch"))


def script_share(output: Column, own: list[str], source: Column) -> Column:
    """Share of the output's letters in the source's own scripts, but for characters that only codes of the source hold."""
    codes = F.array_join(F.regexp_extract_all(source, F.lit(r"(\S*[\d\x{2010}\x{2011}-]\S*)"), F.lit(1)), "")
    prose = F.regexp_replace(source, r"\S*[\d\x{2010}\x{2011}-]\S*", "")
    copied = F.array_except(F.array_distinct(F.split(codes, "")), F.array_distinct(F.split(prose, "")))
    letters = F.filter(F.regexp_extract_all(output, F.lit(r"(\p{L})"), F.lit(1)), lambda c: ~F.array_contains(copied, c))
    own_re = "|".join(rf"\p{{Is{s}}}" for s in own) or "$^"
    return F.coalesce(ratio(F.size(F.filter(letters, lambda c: c.rlike(own_re))), F.size(letters)), F.lit(0.0))


def chunk_containment(sentence: Column, body: Column) -> Column:
    """Whether max(2, a third) of the 6-character chunks of a sentence are in a text."""
    s, t = text.visual_normal(sentence), text.visual_normal(body)
    n = F.greatest(F.lit(1), F.ceil((F.length(s) - 5) / 6)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr(s, k * 6 + 1, F.lit(6)))
    return F.size(F.filter(chunks, lambda c: F.contains(t, c))) >= F.greatest(F.lit(2), F.floor(F.size(chunks) / 3))


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value with the greatest summed weight, the smallest of equal ones."""
    w = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    return w.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_w")).alias("w"), F.col(value))).alias("mode"))


def capped_scale(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Every row's value, no more than its group's weighted mode of values in two places."""
    rounded = df.withColumn("_r", F.bround(value, 2))
    return df.join(weighted_mode(rounded, keys, "_r", weight), keys).withColumn("capped", F.least(value, "mode"))


def line_pitch(df: DataFrame, keys: list[str], y: str, size: str) -> DataFrame:
    """Median distance of lines that are at least half a size apart, in sizes; null for a single line."""
    w = W.partitionBy(*keys).orderBy(F.desc(y))
    d = df.groupBy(*keys, F.bround(y, 1).alias(y)).agg(F.max(size).alias(size)).withColumn("_gap", F.lag(y).over(w) - F.col(y))
    return d.where((F.col("_gap") > 0.5 * F.col(size))).groupBy(*keys).agg(F.expr("percentile(_gap, 0.5)").alias("_p"), F.max(size).alias("_s")).select(*keys, ratio(F.col("_p"), F.col("_s")).alias("pitch"))


def blocks(words: DataFrame, keys: list[str]) -> DataFrame:
    """A block's text (lines by line break), top, greatest size (10 without any) and whether any of it is bold."""
    bold = F.lower(F.coalesce("font", F.lit(""))).rlike("bold|semibold|black|heavy")
    lines = words.groupBy(*keys, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda w: w["text"]), " ").alias("t"), F.min("top").alias("top"), F.max(F.when(F.col("size") > 0, F.col("size"))).alias("size"), F.bool_or(bold).alias("bold"))
    return lines.groupBy(*keys).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")).alias("text"), F.min("top").alias("top"), F.coalesce(F.max("size"), F.lit(10.0)).alias("size"), F.bool_or("bold").alias("bold"))


def real_tables(cells: DataFrame, fake: list[str]) -> DataFrame:
    """table_id, real: two columns and more, no header of a fake one, no column over 70 % empty, no pair of number rows."""
    v = F.trim(F.coalesce("text", F.lit("")))
    col = cells.groupBy("table_id", "column").agg(ratio(F.count_if((v == "") | (v == "nan")), F.count("*")).alias("empty"), F.bool_and(v.rlike(r"^\d*$")).alias("numbers"))
    shape = cells.groupBy("table_id").agg(F.countDistinct("column").alias("columns"), F.countDistinct("row").alias("rows"), F.bool_or((F.col("row") == 0) & v.rlike("^(?:" + "|".join(fake) + ")") if fake else F.lit(False)).alias("fake"))
    c = col.groupBy("table_id").agg(F.max("empty").alias("empty"), F.bool_or((F.col("column") == 0) & F.col("numbers")).alias("numbered"))
    return shape.join(c, "table_id").select("table_id", ((F.col("columns") >= 2) & ~F.col("fake") & (F.col("empty") <= 0.7) & ~((F.col("rows") <= 2) & F.col("numbered"))).alias("real"))


def term_counts(texts: DataFrame, keys: list[str], stopwords: list[str]) -> DataFrame:
    """Recurring terms: words of six letters seen three times, pairs of words seen twice; by count, then term."""
    chunks = F.filter(F.split(F.col("text"), r"\S*[@\d]\S*|\S*://\S*"), lambda c: c != "")
    words = F.transform(F.regexp_extract_all("chunk", F.lit(r"(\p{L}[\p{L}'’-]*)"), F.lit(1)), F.lower)
    w = texts.select(*keys, F.explode(chunks).alias("chunk")).select(*keys, words.alias("w")).where("size(w) > 0")
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    plain = lambda x: ~F.array_contains(stop, x)
    one = w.select(*keys, F.explode(F.filter("w", lambda x: (F.length(x) >= 6) & plain(x))).alias("term"))
    pair = F.filter(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w))").alias("b")), lambda p: plain(p["a"]) & plain(p["b"]) & (F.length(p["a"]) > 2) & (F.length(p["b"]) > 2))
    two = w.where("size(w) > 1").select(*keys, F.explode(pair).alias("p")).select(*keys, F.concat_ws(" ", "p.a", "p.b").alias("term"))
    count = lambda t, least, size: t.groupBy(*keys, "term").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("words", F.lit(size))
    return count(one, 3, 1).unionByName(count(two, 2, 2))


# --- readings of one line by several recognisers ---

READING = "array<struct<text: string, score: double, variant: string, model: string>>"


def _spaceless(c: Column) -> Column:
    return F.regexp_replace(c, text.WS, "")


def consensus(candidates: Column) -> Column:
    """struct(text, review, reason) of readings: they agree but for blanks, or a person looks at the best one."""
    best = F.get(F.array_sort(candidates, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), 0)
    forms = F.array_distinct(F.transform(candidates, lambda c: _spaceless(c["text"])))
    exact = F.array_distinct(F.transform(candidates, lambda c: F.trim(c["text"])))
    sensitive = F.exists(candidates, lambda c: c["text"].rlike(r"(?i)@|\b(?:sk_|API\s*Key)"))
    variants = F.size(F.array_distinct(F.transform(F.filter(candidates, lambda c: c["score"] >= 0.9), lambda c: c["variant"])))
    original = F.coalesce(F.get(F.filter(candidates, lambda c: c["variant"] == "original"), 0), best)
    pick = lambda c, review, reason: F.struct(c["text"].alias("text"), review.alias("review"), F.lit(reason).alias("reason"))
    yes = F.lit(True)
    return (
        F.when(F.size(candidates) == 0, None)
        .when(F.trim(best["text"]) == "", pick(best, yes, "empty_recognition"))
        .when(sensitive & (F.size(exact) > 1), pick(best, yes, "identifier_disagreement"))
        .when(F.size(forms) > 1, pick(best, yes, "character_disagreement"))
        .when(variants >= 2, pick(original, F.lit(False), "character_consensus"))
        .otherwise(pick(best, best["score"] < 0.95, "confidence_or_disagreement"))
    )


def _confident(candidates: Column) -> Column:
    return F.filter(candidates, lambda c: (c["score"] >= 0.85) & (F.trim(c["text"]) != ""))


def _models(candidates: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.transform(candidates, lambda c: c["model"]), lambda m: m.isNotNull())))


def _same(body: Column):
    return lambda c: F.lower(_spaceless(c["text"])) == F.lower(_spaceless(body))


def read_alike(body: Column, candidates: Column) -> Column:
    """Two models and more, and every confident reading has the text, case and blanks aside."""
    c = _confident(candidates)
    return (_spaceless(body) != "") & (F.size(c) > 0) & F.forall(c, _same(body)) & (_models(c) >= 2)


def reads_consistently(body: Column, candidates: Column) -> Column:
    """Confident readings of two models and more have the text, and outnumber those that differ."""
    c = _confident(candidates)
    agree = F.filter(c, _same(body))
    return (_spaceless(body) != "") & (F.size(agree) > F.size(c) - F.size(agree)) & (_models(agree) >= 2)


def independent_evidence(body: Column, candidates: Column) -> Column:
    """No strong reading differs, and both models show it in enough variants."""
    scored = F.forall(candidates, lambda c: c["text"].isNotNull() & c["score"].between(0, 1))
    same = F.filter(candidates, _same(body))
    differs = F.exists(candidates, lambda c: (c["score"] >= 0.95) & ~_same(body)(c))
    models = F.array_distinct(F.transform(same, lambda c: c["model"]))
    variants = lambda m, at: F.size(F.array_distinct(F.transform(F.filter(same, lambda c: (c["model"] == m) & (c["score"] >= at)), lambda c: c["variant"])))
    normal, targeted = F.transform(models, lambda m: variants(m, 0.9)), F.transform(models, lambda m: variants(m, 0.85))
    strong = F.size(F.filter(same, lambda c: c["score"] >= 0.95)) >= 2
    return scored & ~differs & (F.size(models) >= 2) & (((F.array_min(normal) >= 1) & (F.array_max(normal) >= 2)) | ((F.array_min(targeted) >= 2) & strong))


def multiset_overlap(a: Column, b: Column, least: float = 0.8, most_ratio: float = 1.5) -> Column:
    """Whether two texts share `least` of the longer one's characters and differ little in length."""
    x, y = F.split(_spaceless(a), ""), F.split(_spaceless(b), "")
    longer = F.greatest(F.size(x), F.size(y))
    return (token_recall(x, y) * F.size(x) >= least * longer) & (longer <= most_ratio * F.least(F.size(x), F.size(y)))


def comparable(reports: DataFrame) -> DataFrame:
    """Side-by-side metrics of two reports and more; refused unless all have one comparison key."""
    check = reports.agg(F.countDistinct("comparison_key").alias("k"), F.countDistinct("report").alias("n"))
    ok = check.select(F.when((F.col("k") == 1) & (F.col("n") >= 2), F.lit(True)).otherwise(F.raise_error(F.lit("reports are not comparable"))).alias("ok"))
    return reports.crossJoin(F.broadcast(ok)).where("ok").drop("ok").groupBy("metric").pivot("report").agg(F.first("value"))


def changed_outcomes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose outcome differs between two runs, or that one run lacks."""
    x, y = a.select(*keys, F.col("outcome").alias("before")), b.select(*keys, F.col("outcome").alias("after"))
    return x.join(y, keys, "full").where(~F.col("before").eqNullSafe(F.col("after")))
