"""Scores of predictions against references: documents, pages, text, tables and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.functions import geometry as G
from vellumite.functions import predicates, text
from vellumite.operators import aggregates, joins, matching


def guard(references: DataFrame, predictions: DataFrame) -> None:
    """Refuse duplicate documents, predictions without a reference, and mixed settings."""
    if not references.groupBy("source_sha256").count().where("count > 1").isEmpty():
        raise ValueError("duplicate references")
    if not predictions.groupBy("source_sha256").count().where("count > 1").isEmpty():
        raise ValueError("several predictions for one document")
    if not predictions.join(references, "source_sha256", "left_anti").isEmpty():
        raise ValueError("predictions outside the references")
    if predictions.agg(F.countDistinct(F.struct("backend", "backend_version", "settings"))).first()[0] > 1:
        raise ValueError("mixed settings")


def invalid(documents: DataFrame) -> DataFrame:
    """Documents that break a rule, with the rules."""
    rules = predicates.document_rules(F.col("source_sha256"), F.col("coordinate_system"), F.col("pages"))
    return documents.select("source_sha256", rules.alias("rules")).where("size(rules) > 0")


def evaluate(references: DataFrame, predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts of every reference document, in the order of hashes. A missing prediction or page counts as an empty one."""
    guard(references, predictions)
    key = ["source_sha256", "page"]
    ref = references.select("source_sha256", F.explode("pages").alias("p")).select("source_sha256", F.col("p.number").alias("page"), "p.tasks", "p.text", "p.tables", "p.figures")
    pred = predictions.select("source_sha256", F.explode("pages").alias("p")).select("source_sha256", F.col("p.number").alias("page"), F.col("p.regions").alias("regions"))
    both = ref.join(pred, key, "left").withColumn("regions", F.coalesce("regions", F.expr("cast(array() as array<struct<id:string,kind:string,bbox:array<double>,text:string,cells:array<array<string>>>>)")))
    body = F.array_join(F.transform(F.filter("regions", lambda r: (r["kind"] == "text") & r["text"].isNotNull()), lambda r: r["text"]), "\n")
    t = both.where(F.array_contains("tasks", "text")).select("source_sha256", text.text_counts(F.coalesce("text", F.lit("")), body).alias("c")).select("source_sha256", "c.*")
    out = t.groupBy("source_sha256").agg(F.count("*").alias("text_pages"), *(F.sum(c).cast("long").alias(c) for c in ("character_errors", "reference_characters", "word_errors", "reference_words")))
    for task, kind in (("tables", "table"), ("figures", "figure")):
        on = both.where(F.array_contains("tasks", task))
        boxed = lambda df, c: df.select(*key, F.explode(c).alias("r")).select(*key, F.col("r.id").alias("id"), G.from_array(F.col("r.bbox")).alias("box"), *([F.col("r.cells").alias("cells")] if task == "tables" else []))  # noqa: E731, B023
        a, b = boxed(on, F.col(task)), boxed(on, F.filter("regions", lambda r: r["kind"] == kind))  # noqa: B023
        m = matching.match_most(joins.iou_candidates(a, b, key, threshold), key)
        n = lambda df, name: df.groupBy("source_sha256").agg(F.count("*").alias(name))
        s = n(a, "r").join(n(b, "p"), "source_sha256", "full").join(m.groupBy("source_sha256").agg(F.count("*").alias("tp"), F.sum("score").alias("iou")), "source_sha256", "left").na.fill(0)
        out = out.join(s.select("source_sha256", F.col("tp").alias(f"{task}_tp"), (F.col("p") - F.col("tp")).alias(f"{task}_fp"), (F.col("r") - F.col("tp")).alias(f"{task}_fn"), F.col("iou").alias(f"{task}_iou_sum")), "source_sha256", "full")
        if task == "tables":
            pairs = m.select(*key, "left_id", "right_id").join(a.select(*key, F.col("id").alias("left_id"), F.col("cells").alias("rc")), [*key, "left_id"]).join(b.select(*key, F.col("id").alias("right_id"), F.col("cells").alias("pc")), [*key, "right_id"])
            slots = lambda df, c: aggregates.table_slots(df.select("source_sha256", "page", "left_id", F.col(c).alias("cells")), ["source_sha256", "page", "left_id"])
            tp = aggregates.slot_counts(slots(pairs, "rc"), slots(pairs, "pc"), ["source_sha256", "page", "left_id"]).groupBy("source_sha256").agg(F.sum("cell_tp").alias("cell_tp"))
            size = lambda df, name: df.groupBy("source_sha256").agg(F.sum(F.aggregate("cells", F.lit(0), lambda acc, r: acc + F.size(r))).alias(name))
            dims = pairs.groupBy("source_sha256").agg(F.count_if((F.size("rc") == F.size("pc")) & F.coalesce(F.size(F.get("rc", 0)) == F.size(F.get("pc", 0)), F.lit(True))).alias("table_dimensions_correct"))
            c = size(a, "rs").join(size(b, "ps"), "source_sha256", "full").join(tp, "source_sha256", "left").join(dims, "source_sha256", "left").na.fill(0)
            out = out.join(c.select("source_sha256", "cell_tp", (F.col("ps") - F.col("cell_tp")).alias("cell_fp"), (F.col("rs") - F.col("cell_tp")).alias("cell_fn"), "table_dimensions_correct"), "source_sha256", "left")
    seen = predictions.select("source_sha256", F.lit(False).alias("missing_prediction"))
    return references.select("source_sha256", "source_name").join(out.na.fill(0), "source_sha256", "left").join(seen, "source_sha256", "left").na.fill(0).na.fill(True, ["missing_prediction"]).orderBy("source_sha256")


def review_state(counts: DataFrame) -> DataFrame:
    """requires_revision for blockers, human_accepted for complete and accepted reviews, else requires_review."""
    blocked = (F.col("missing_regions") + F.col("layout_issues") + F.col("critical") + F.col("major") > 0) | (F.col("preserved") < F.col("literals"))
    complete = (F.col("source_reviewed") == F.col("regions")) & (F.col("translation_reviewed") == F.col("regions")) & F.col("visual_reviewed")
    return counts.withColumn("acceptance", F.when(blocked, "requires_revision").when(complete & F.col("human_accepted"), "human_accepted").otherwise("requires_review"))
