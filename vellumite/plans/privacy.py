"""Document-level flow: rules, field labels, names, post-filters, masks, review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumite.functions import pii, predicates, text
from vellumite.operators import joins, selection

FINDING = ["doc_id", "region_id", "value", "category", "method"]


def rule_findings(units: DataFrame, categories: list[str]) -> DataFrame:
    """Findings of the rules in units (doc_id, region_id, text), read where they lie."""
    found = units.where("text is not null").select("doc_id", "region_id", F.explode(pii.detect(F.col("text"), categories)).alias("f"))
    return found.select("doc_id", "region_id", "f.value", "f.category", "f.method")


def label_findings(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Values whose field label a provider has named a category for, if they have its format.

    A cell that has a row label is not judged by its column's header."""
    p = pairs.join(decisions.select("label", F.col("category").alias("decision")), "label")
    rows = p.where("kind = 'row'").select("doc_id", "region_id").distinct()
    by_column = p.where("kind = 'column'").join(rows, ["doc_id", "region_id"], "left_anti")
    kept = p.where("kind <> 'column'").unionByName(by_column)
    return kept.where((F.col("decision") != "none") & (F.trim("value") != "") & predicates.format_ok(F.col("value"), F.col("decision"))).select("doc_id", "region_id", "value", F.col("decision").alias("category"), F.lit("field_label").alias("method"))


def overruled(findings: DataFrame, pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Model findings of identifiers or accounts that stand only under column headers which are not personal."""
    p = pairs.join(decisions.select("label", F.col("category").alias("decision")), "label").select("doc_id", text.compact(F.col("value")).alias("key"), "decision", "kind")
    personal = p.where("decision <> 'none'").select("doc_id", "key").distinct()
    plain = p.where("decision = 'none' and kind = 'column'").select("doc_id", "key").distinct().join(personal, ["doc_id", "key"], "left_anti")
    asked = findings.where("method = 'model_proposal'").where(F.col("category").isin("Identifiers", "Bank accounts")).withColumn("key", text.compact(F.col("value")))
    return asked.join(plain, ["doc_id", "key"], "left_semi").drop("key")


def known_values(units: DataFrame, values: DataFrame) -> DataFrame:
    """Values (doc_id, value, category) known from elsewhere, of three characters and more, wherever they stand again."""
    v = values.where(F.length(text.compact(F.col("value"))) >= 3).where(F.col("category").isin(predicates.CATEGORIES))
    hit = units.join(v, "doc_id").withColumn("spans", pii.literal_spans_of("text", "value")).where("size(spans) > 0")
    return hit.select("doc_id", "region_id", "value", "category", F.lit("document_consistency").alias("method"))


def post_filter(findings: DataFrame, units: DataFrame, categories: list[str], headers: DataFrame | None = None) -> DataFrame:
    """What is left of all findings: headers, labels, handles, dates, digits in names and stray marks are dealt with."""
    f = findings
    if headers is not None:
        f = f.withColumn("key", text.compact(F.col("value"))).join(headers.select("doc_id", text.compact(F.col("text")).alias("key")).distinct(), ["doc_id", "key"], "left_anti").drop("key")
    bare = (F.col("method") == "model_proposal") & F.col("category").isin("Identifiers", "Bank accounts") & ~F.col("value").rlike(r"[\d_@.:/#-]")
    f = f.where(~bare)
    handle = (F.col("category") == "Names") & F.trim("value").rlike(r"^[a-z0-9]+(?:[._][a-z0-9]+)+$")
    outside = units.select("doc_id", F.explode(F.regexp_extract_all(F.regexp_replace("text", r"(?<!\S)\S*?@\S*", " "), F.lit(r"(?<![\w.@])([a-z0-9]+(?:[._][a-z0-9]+)+)(?![\w@])"), F.lit(1))).alias("h")).distinct()
    is_handle = F.coalesce(handle, F.lit(False))
    # an inner join with distinct rows: a semi join would be pushed below the union of f, and texts read for each part of it
    kept = f.where(is_handle).withColumn("h", F.trim("value")).join(outside, ["doc_id", "h"]).withColumn("category", F.lit("Identifiers")).select(*f.columns)
    f = f.where(~is_handle).union(kept)
    f = f.withColumn("category", predicates.normalize_category(F.col("value"), F.col("category"))).where(F.col("category").isin(categories))
    name = F.col("category") == "Names"
    f = f.withColumn("value", F.when(name, text.strip_honorific(F.col("value"))).otherwise(F.col("value"))).where(predicates.plausible(F.col("value"), F.col("category")) | ~(name | F.col("category").isin("Identifiers", "Bank accounts")))
    f = f.where((F.col("category") == "Dates of birth") | ~predicates.is_date(F.col("value")))
    trimmed = F.regexp_replace("value", "[.,;:]+$", "")
    f = f.withColumn("value", F.when(F.length(text.compact(trimmed)) >= 2, trimmed).otherwise(F.col("value")))
    f = f.join(units.select("doc_id", "region_id", "text"), ["doc_id", "region_id"]).where(F.contains("text", "value"))
    first = f.groupBy("doc_id", "region_id", "value", "category").agg(F.min_by("method", F.array_position(F.array(*map(F.lit, predicates.METHODS)), F.col("method"))).alias("method"))
    return first


def detect_document(units: DataFrame, pairs: DataFrame, decisions: DataFrame, names: DataFrame, categories: list[str], headers: DataFrame | None = None, proposals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of all layers, filtered, and the model findings that a column header overruled.

    decisions(label, category), names(name) and proposals(doc_id, region_id, value, category) are a provider's answers
    (see providers); without a model they are empty."""
    f = rule_findings(units, categories).unionByName(label_findings(pairs, decisions))
    suppressed = None
    if proposals is not None:
        asked = proposals.withColumn("method", F.lit("model_proposal")).select(*FINDING)
        suppressed = overruled(asked, pairs, decisions)
        f = f.unionByName(asked.join(suppressed, FINDING, "left_anti"))
    if "Names" in categories:
        flat = units.select(F.struct("doc_id", "region_id").alias("id"), "text")
        at = lambda found, method: found.select("id.doc_id", "id.region_id", F.col("name").alias("value"), F.lit("Names").alias("category"), F.lit(method).alias("method"))
        words = joins.name_words(names, units.select("text")).select(F.col("word").alias("name"))
        f = f.unionByName(at(joins.name_occurrences(flat, names), "document_name_sweep")).unionByName(at(joins.name_occurrences(flat, words, longer=names), "name_variant"))
    out = post_filter(f.withColumn("doc_id", F.col("doc_id").cast("string")), units.withColumn("doc_id", F.col("doc_id").cast("string")), categories, headers)
    return out, suppressed if suppressed is not None else f.limit(0)


def split_kept(findings: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Findings to mask, and those that stay visible."""
    kept = F.coalesce(predicates.kept_visible(F.col("value"), keep), F.lit(False))
    return findings.where(~kept), findings.where(kept)


def mask_units(units: DataFrame, findings: DataFrame) -> DataFrame:
    """Units with all values of their document masked, wherever they stand."""
    v = findings.groupBy("doc_id").agg(F.collect_set("value").alias("values"))
    return units.join(v, "doc_id", "left").withColumn("text", F.coalesce(pii.mask("text", F.coalesce("values", F.array().cast("array<string>"))), "text")).drop("values")


def review_queue(findings: DataFrame, suppressed: DataFrame, unreadable: DataFrame, places: DataFrame, limit: int = 200) -> DataFrame:
    """Places to look at, without any text: whole units masked, findings overruled, lines that could not be read."""
    masked = findings.where("method = 'unverifiable_model_answer'").select("region_id", "category", F.lit("unverified_answer").alias("reason"), F.lit("masked").alias("state"))
    gone = findings.select(text.compact(F.col("value")).alias("key")).distinct()
    over = suppressed.withColumn("key", text.compact(F.col("value"))).join(gone, "key", "left_anti").select("region_id", "category", F.lit("rule_overruled_model").alias("reason"), F.lit("suggested").alias("state"))
    dark = unreadable.join(findings.select("region_id").distinct(), "region_id", "left_anti").select("region_id", F.lit("Unknown").alias("category"), F.lit("unreadable_text").alias("reason"), F.lit("suggested").alias("state"))
    return selection.queue(masked.unionByName(over).unionByName(dark).join(places, "region_id").drop("region_id"), limit)


def final_check(detected: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Findings in outputs (page, width, height, box, value, category): areas to mask, and those that no area can be given."""
    from vellumite.functions import geometry as G

    still, _ = split_kept(detected.where("value is not null and value <> ''"), keep)
    placed = G.locatable(F.col("box"), F.col("width"), F.col("height"))
    f = still.withColumn("f", F.when(placed, G.page_fractions(F.col("box"), F.col("width"), F.col("height"))))
    areas = f.where("f is not null").select("page", "f.*", "category").dropDuplicates(["page", "x", "y", "width", "height"])
    return areas.withColumn("reason", F.lit("final_check")), still.where(~placed)


def valid_proposals(answers: DataFrame, units: DataFrame, categories: list[str]) -> DataFrame:
    """A model's answers (region_id, answer JSON) as findings that the text supports word for word.

    An answer that is no such JSON, or has a value that is not in the text, is refused as a whole (valid false)."""
    parsed = F.from_json("answer", "findings array<struct<category: string, value: string>>")
    a = answers.join(units.select("region_id", "text"), "region_id").withColumn("p", parsed["findings"])
    ok = F.col("p").isNotNull() & F.forall("p", lambda x: x["category"].isin(categories) & (F.trim(x["value"]) != "") & F.contains(F.col("text"), x["value"]))
    label = lambda x: F.col("text").rlike(F.concat(F.lit(r"(?:^|[\n|])[ \t]*\Q"), F.trim(x["value"]), F.lit(r"\E[ \t]*[:：]")))
    keep = lambda x: ~((x["category"] != "Dates of birth") & predicates.is_date(x["value"])) & ~((x["category"] == "Names") & x["value"].rlike(r"\d")) & ~((F.size(F.split(x["value"], r"\s+")) > 1) & F.exists(F.split(x["value"], r"\s+"), lambda w: w.rlike(f"^{predicates.EMAIL}$")))
    return a.select("region_id", F.coalesce(ok, F.lit(False)).alias("valid"), F.when(F.coalesce(ok, F.lit(False)), F.filter("p", keep)).alias("findings"))


def category_label(style: str, category: Column, pseudonym: Column) -> Column:
    from vellumite.operators.windows import category_label as label

    return {"box": F.lit("[REDACTED]"), "label": label(category), "pseudonym": pseudonym}[style]
