"""Nested documents as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import geometry as G


def text_regions(content: DataFrame) -> DataFrame:
    """A row for each text region and each table cell that is not empty; cells carry their header and row."""
    r = content.select("doc_id", F.explode("units").alias("u")).select("doc_id", F.col("u.number").alias("unit_number"), F.explode("u.regions").alias("r"))
    plain = r.where("r.text is not null and trim(r.text) <> ''").select(
        "doc_id", "unit_number", F.col("r.id").alias("region_id"), F.col("r.text").alias("text"), F.col("r.bbox").alias("bbox"), F.lit(None).cast("string").alias("table_parent"),
        F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("column"), F.lit(None).cast("string").alias("column_header"), F.lit(None).cast("array<string>").alias("row_values"),
    )
    rows = r.where("size(r.cells) > 0").select("doc_id", "unit_number", F.col("r.id").alias("parent"), F.col("r.bbox").alias("bbox"), F.col("r.cells")[0].alias("head"), F.posexplode("r.cells").alias("row", "cells"))
    cells = rows.select("doc_id", "unit_number", "parent", "bbox", "head", "row", F.col("cells").alias("row_values"), F.posexplode("cells").alias("column", "text")).where("text is not null and trim(text) <> ''")
    cells = cells.select(
        "doc_id", "unit_number", F.format_string("%s:r%d:c%d", "parent", "row", "column").alias("region_id"), "text", "bbox", F.col("parent").alias("table_parent"),
        "row", "column", F.get("head", F.col("column")).alias("column_header"), "row_values",
    )
    return plain.unionByName(cells)


def content_ir(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents with their pages (doc_id, number, width, height, regions) nested, in order."""
    units = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", F.format_string("p%d", "number").alias("id"), F.lit("page").alias("kind"), "width", "height", "regions"))).alias("units"))
    return documents.join(units, "doc_id", "left")


def stable_ids(regions: DataFrame) -> DataFrame:
    """p{page}_r{place} by (y0, x0), so that a rerun names regions alike."""
    w = W.partitionBy("doc_id", "page").orderBy(F.col("box")["y0"], F.col("box")["x0"], F.col("text"))
    return regions.withColumn("region_id", F.format_string("p%d_r%d", "page", F.row_number().over(w)))


def line_regions(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Words outside tables, joined to lines of one (block, line): text in order of x0, and the box around them."""
    from vellumite.operators.joins import first_inside

    free = first_inside(words, tables, ["doc_id", "page"]).where("table_id is null")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col("box")["x0"].alias("x"), "text"))), lambda w: w["text"])
    return free.groupBy("doc_id", "page", "block", "line").agg(F.array_join(parts, " ").alias("text"), G.union_box(F.collect_list("box")).alias("box"))


def distinct_images(images: DataFrame) -> DataFrame:
    """Images without those that a smaller id covers almost wholly, both ways."""
    from vellumite.operators.joins import overlapping_pairs

    pairs = overlapping_pairs(images, ["doc_id", "page"])
    same = (G.fraction_of_first(F.col("a_box"), F.col("b_box")) > 0.98) & (G.fraction_of_first(F.col("b_box"), F.col("a_box")) > 0.98)
    return images.join(pairs.where(same).select("doc_id", "page", F.col("b_id").alias("id")).distinct(), ["doc_id", "page", "id"], "left_anti")


def preferred(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the first detector, in `order`, that found something on a page."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("detector"))
    w = W.partitionBy(*keys)
    return candidates.withColumn("_r", rank).where("_r > 0").withColumn("_m", F.min("_r").over(w)).where("_r = _m").drop("_r", "_m")


def accepted_tables(tables: DataFrame, words: DataFrame) -> DataFrame:
    """Tables (doc_id, page, id, box, tokens) whose cells hold every word that lies in them by more than .85."""
    from vellumite.operators.joins import box_join

    t = tables.select("doc_id", "page", F.col("id").alias("table_id"), F.col("box").alias("t_box"), "tokens")
    w = words.select("doc_id", "page", "text", F.col("box").alias("w_box"))
    inside = box_join(t, w, ["doc_id", "page"], "t_box", "w_box", G.fraction_of_first(F.col("w_box"), F.col("t_box")) > 0.85)
    need = inside.groupBy("doc_id", "page", "table_id", "text").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"))
    have = F.size(F.filter("tokens", lambda x: x == F.col("text")))
    short = need.where(have < F.col("n")).select("doc_id", "page", "table_id").distinct()
    return tables.join(short, [tables.doc_id == short.doc_id, tables.page == short.page, tables.id == short.table_id], "left_anti")


def markdown(elements: DataFrame) -> DataFrame:
    """doc_id, markdown: texts, tables and images in order of page and y, with a marker at each new page."""
    from vellumite.operators.windows import keep_first

    e = keep_first(elements, ["doc_id", "kind"], ["page", "y"])
    w = W.partitionBy("doc_id").orderBy("page", "y")
    mark = F.when(~F.col("page").eqNullSafe(F.lag("page").over(w)), F.format_string("<!-- page %d -->\n\n", "page")).otherwise("")
    body = F.when(F.col("kind") == "image", F.format_string("![figure](%s)", "text")).otherwise(F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "y", "part"))), lambda p: p["part"])
    return e.withColumn("part", F.concat(mark, body)).groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("markdown"))


def with_median_size(elements: DataFrame) -> DataFrame:
    """Elements with the median size of their document (10 without any)."""
    return elements.withColumn("median", F.coalesce(F.expr("percentile(size, 0.5) OVER (PARTITION BY doc_id)"), F.lit(10.0)))
