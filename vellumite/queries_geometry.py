"""Queries over boxes: `part` rows as boxes of pages of forty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.catalog import query, table
from vellumite.functions import geometry as G
from vellumite.operators import aggregates, joins, matching, selection, windows

BOX = """box AS (SELECT p_partkey // 40 AS page, p_partkey AS id, CAST((p_partkey * 37) % 400 AS DOUBLE) AS x0, CAST((p_partkey * 53) % 600 AS DOUBLE) AS y0,
    CAST((p_partkey * 37) % 400 + 20 + p_size AS DOUBLE) AS x1, CAST((p_partkey * 53) % 600 + 8 + p_size % 13 AS DOUBLE) AS y1, p_name AS text, p_brand AS kind, p_size AS size FROM part)"""


def boxes(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    x0, y0 = (k * 37 % 400).cast("double"), (k * 53 % 600).cast("double")
    x1, y1 = (k * 37 % 400 + 20 + F.col("p_size")).cast("double"), (k * 53 % 600 + 8 + F.col("p_size") % 13).cast("double")
    return p.select(F.floor(k / 40).alias("page"), k.alias("id"), G.box(x0, y0, x1, y1).alias("box"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.col("p_name").alias("text"), F.col("p_brand").alias("kind"), F.col("p_size").alias("size"))


OVERLAP = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
AREA = lambda t: f"(({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0))"


@query(f"WITH {BOX} SELECT a.page, a.id AS a_id, b.id AS b_id, round({OVERLAP} / ({AREA('a')} + {AREA('b')} - {OVERLAP}), 6) AS iou FROM box a JOIN box b ON a.page = b.page AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def iou_pairs(spark, sf_dir):
    """Intersecting pairs with IoU (NUM-01, JN-07)."""
    return joins.overlapping_pairs(boxes(spark, sf_dir), ["page"]).select("page", "a_id", "b_id", F.round(G.iou(F.col("a_box"), F.col("b_box")), 6).alias("iou"))


@query(f"WITH {BOX} SELECT a.page, a.id AS a_id, b.id AS b_id FROM box a JOIN box b ON a.page = b.page AND a.id < b.id WHERE {OVERLAP} > 0.35 * least({AREA('a')}, {AREA('b')})")
def overlap_pairs(spark, sf_dir):
    """Pairs of which over 35 % of the smaller is covered (JN-08)."""
    return joins.text_overlaps(boxes(spark, sf_dir), ["page"]).select("page", "a_id", "b_id")


@query(f"WITH {BOX}, c AS (SELECT page, id, x0 - 30 AS x0, y0 - 30 AS y0, x1 + 30 AS x1, y1 + 30 AS y1 FROM box WHERE kind = 'Brand#1') SELECT a.page, a.id AS region_id, CAST(count(*) AS INTEGER) AS containers FROM box a JOIN c b ON a.page = b.page WHERE {OVERLAP} / {AREA('a')} > 0.65 GROUP BY ALL")
def regions_in_containers(spark, sf_dir):
    """Regions mostly inside larger areas (JN-10, NUM-04)."""
    b = boxes(spark, sf_dir)
    wide = b.where("kind = 'Brand#1'").select("page", "id", G.box(F.col("x0") - 30, F.col("y0") - 30, F.col("x1") + 30, F.col("y1") + 30).alias("box"))
    return joins.inside(b, wide, ["page"]).select("page", "region_id", F.size("container_ids").alias("containers"))


@query(f"WITH {BOX}, c AS (SELECT page, id, x0 - 30 AS x0, y0 - 30 AS y0, x1 + 30 AS x1, y1 + 30 AS y1 FROM box WHERE kind = 'Brand#1') SELECT a.page, a.id AS word_id, coalesce(min(b.id), -1) AS table_id FROM box a LEFT JOIN c b ON a.page = b.page AND {OVERLAP} / {AREA('a')} >= 0.65 GROUP BY ALL")
def words_in_first_table(spark, sf_dir):
    """The first table that holds a word (SRC-04)."""
    b = boxes(spark, sf_dir)
    wide = b.where("kind = 'Brand#1'").select("page", "id", G.box(F.col("x0") - 30, F.col("y0") - 30, F.col("x1") + 30, F.col("y1") + 30).alias("box"))
    return joins.first_inside(b.select("page", "id", "box"), wide, ["page"]).select("page", "word_id", F.coalesce("table_id", F.lit(-1)).alias("table_id"))


@query(f"""WITH {BOX}, h AS (SELECT a.page, a.id AS label_id, b.id AS value_id, row_number() OVER (PARTITION BY a.page, a.id ORDER BY b.x0, b.id) AS n FROM box a JOIN box b ON a.page = b.page AND a.id <> b.id
    AND b.x0 >= a.x1 - 1 AND abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= greatest(1, a.y1 - a.y0) / 2) SELECT page, label_id, value_id FROM h WHERE n = 1""")
def nearest_right(spark, sf_dir):
    """The nearest block to the right on one line (JN-17)."""
    b = boxes(spark, sf_dir)
    return joins.nearest_right(b, b, ["page"])


@query(f"""WITH {BOX}, h AS (SELECT a.page, a.id AS region_id, b.id AS other_id, row_number() OVER (PARTITION BY a.page, a.id ORDER BY b.y0, b.x0, b.id) AS n FROM box a JOIN box b ON a.page = b.page AND a.id <> b.id WHERE
    (abs(a.x0 - b.x0) <= greatest(a.y1 - a.y0, b.y1 - b.y0) AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND abs(a.y0 - b.y0) <= greatest(a.y1 - a.y0, b.y1 - b.y0) * 3)
    OR (abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= greatest(a.y1 - a.y0, b.y1 - b.y0) * 0.5 AND abs(a.x0 - b.x0) <= greatest(a.y1 - a.y0, b.y1 - b.y0) * 12))
    SELECT page, region_id, other_id, CAST(n AS INTEGER) AS n FROM h WHERE n <= 6""")
def nearby_regions(spark, sf_dir):
    """Up to six neighbours in column or row (JN-27)."""
    return joins.neighbours(boxes(spark, sf_dir).withColumn("requires_review", F.lit(False)), ["page"])


@query(f"""WITH {BOX}, h AS (SELECT a.page, a.id AS region_id, b.id AS other_id, row_number() OVER (PARTITION BY a.page, a.id ORDER BY b.y0, b.id) AS n FROM box a JOIN box b ON a.page = b.page AND a.id <> b.id
    WHERE b.y0 >= a.y1 AND b.y0 - a.y1 <= (a.y1 - a.y0) * 20 AND abs(b.x0 - a.x0) <= a.y1 - a.y0) SELECT page, region_id, other_id, CAST(n AS INTEGER) AS n FROM h WHERE n <= 2""")
def column_examples(spark, sf_dir):
    """The next two aligned regions below (JN-28)."""
    return joins.lower_examples(boxes(spark, sf_dir), ["page"])


@query(f"""WITH {BOX}, s AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, y1, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM box),
    g AS (SELECT *, sum(CASE WHEN low IS NULL OR y0 - low > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, y1, x0 ROWS UNBOUNDED PRECEDING) - 1 AS grp FROM s)
    SELECT page, CAST(grp AS BIGINT) AS "group", min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM g GROUP BY page, grp""")
def interval_pack(spark, sf_dir):
    """Boxes joined along y (WIN-04)."""
    return windows.pack(boxes(spark, sf_dir), ["page"], 4.0)


@query(f"""WITH {BOX}, s AS (SELECT page, x0, sum(CASE WHEN x0 - p > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0 ROWS UNBOUNDED PRECEDING) + 0 AS c FROM (SELECT page, x0, lag(x0) OVER (PARTITION BY page ORDER BY x0) AS p FROM box))
    SELECT page, CAST(c AS BIGINT) AS cluster, round(avg(x0), 6) AS mean, count(*) AS n FROM s GROUP BY page, c""")
def cluster_1d(spark, sf_dir):
    """Clusters of left edges (WIN-06)."""
    return windows.clusters(boxes(spark, sf_dir), ["page"], "x0", 12.0).select("page", "cluster", F.round("mean", 6).alias("mean"), "n")


@query(f"""WITH {BOX}, s AS (SELECT page, id, y0 AS top, x0, y1 AS bottom, lag(y0) OVER (PARTITION BY page ORDER BY y0, x0) AS p FROM box),
    l AS (SELECT *, sum(CASE WHEN p IS NULL OR abs(top - p) > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY top, x0 ROWS UNBOUNDED PRECEDING) - 1 AS line FROM s),
    m AS (SELECT page, line, min(top) AS top, max(bottom) AS bottom, count(*) AS words FROM l GROUP BY page, line),
    b AS (SELECT *, sum(CASE WHEN q IS NULL OR top - q > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line ROWS UNBOUNDED PRECEDING) - 1 AS block FROM (SELECT *, lag(bottom) OVER (PARTITION BY page ORDER BY line) AS q FROM m))
    SELECT page, CAST(block AS BIGINT) AS block, count(*) AS lines, CAST(sum(words) AS BIGINT) AS words FROM b GROUP BY page, block""")
def lines_and_blocks(spark, sf_dir):
    """Words to lines to blocks (WIN-02, WIN-03)."""
    w = boxes(spark, sf_dir).select("page", "id", F.col("y0").alias("top"), "x0", F.col("y1").alias("bottom"))
    lines = windows.word_lines(w, ["page"]).groupBy("page", "line").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count("*").alias("words"))
    return windows.line_blocks(lines, ["page"]).groupBy("page", "block").agg(F.count("*").alias("lines"), F.sum("words").alias("words"))


@query(f"WITH {BOX} SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY round_even(y0 / 3, 0), x0, kind, id) AS INTEGER) AS place FROM box")
def reading_order(spark, sf_dir):
    """Place on the page (SRT-01)."""
    return selection.reading_order(boxes(spark, sf_dir), ["page"]).select("page", "id", "place")


@query(f"""WITH {BOX}, p AS (SELECT page, id, greatest(0.0, x0 - 1) AS x0, greatest(0.0, y0 - 1) AS y0, least(440.0, x1 + 1) AS x1, least(610.0, y1 + 1) AS y1 FROM box)
    SELECT page, id, round_even(x0 / 440, 4) AS x, round_even(y0 / 610, 4) AS y, round_even((x1 - x0) / 440, 4) AS width, round_even((y1 - y0) / 610, 4) AS height FROM p WHERE x1 > x0 AND y1 > y0""")
def page_fractions(spark, sf_dir):
    """Padded and clipped boxes as fractions of the page (NUM-03, NUM-13)."""
    f = G.page_fractions(F.col("box"), F.lit(440.0), F.lit(610.0))
    return boxes(spark, sf_dir).select("page", "id", f.alias("f")).where("f is not null").select("page", "id", "f.*")


@query(f"WITH {BOX} SELECT page, id, round_even(x0, 2) AS x0, round_even(610 - y1, 2) AS y0, round_even(610 - y0, 2) AS y1, x0 >= 0 AND y0 >= 0 AND x1 <= 440.01 AND y1 <= 600.01 AS valid FROM box")
def flipped_boxes(spark, sf_dir):
    """Boxes with the other origin, and whether they are on the page (NUM-09, NUM-26, PRJ-02)."""
    b = boxes(spark, sf_dir)
    f = G.rounded2(G.flip(F.col("box"), F.lit(610.0)))
    return b.select("page", "id", f["x0"].alias("x0"), f["y0"].alias("y0"), f["y1"].alias("y1"), G.valid(F.col("box"), F.lit(440.0), F.lit(600.0)).alias("valid"))


@query(f"WITH {BOX}, w AS (SELECT page, size, sum(x1 - x0) AS w FROM box GROUP BY ALL), m AS (SELECT page, size, row_number() OVER (PARTITION BY page ORDER BY w DESC, size) AS n FROM w) SELECT page, size AS mode FROM m WHERE n = 1")
def page_mode(spark, sf_dir):
    """Weighted mode of sizes, the smallest on ties (AGG-22)."""
    return aggregates.weighted_mode(boxes(spark, sf_dir).withColumn("w", F.col("x1") - F.col("x0")), ["page"], "size", "w")


@query(f"""WITH {BOX}, r AS (SELECT page, id, size / 10.0 AS scale, x1 - x0 AS w FROM box), m AS (SELECT page, s, row_number() OVER (PARTITION BY page ORDER BY w DESC, s) AS n FROM (SELECT page, round_even(CAST(scale AS DOUBLE), 2) AS s, sum(w) AS w FROM r GROUP BY ALL))
    SELECT r.page, r.id, round(least(CAST(r.scale AS DOUBLE), m.s), 6) AS capped FROM r JOIN m ON r.page = m.page AND m.n = 1""")
def capped_scales(spark, sf_dir):
    """Scales held down to the page's mode (AGG-23)."""
    b = boxes(spark, sf_dir).select("page", "id", (F.col("size") / 10.0).alias("scale"), (F.col("x1") - F.col("x0")).alias("w"))
    return aggregates.capped_scale(b, ["page"], "scale", "w").select("page", "id", F.round("capped", 6).alias("capped"))


@query(f"""WITH {BOX}, d AS (SELECT page, y0, lag(y0) OVER (PARTITION BY page ORDER BY y0 DESC) - y0 AS gap FROM (SELECT DISTINCT page, y0 FROM box)) SELECT page, round(quantile_cont(gap, 0.5) / 4.0, 6) AS pitch FROM d WHERE gap > 2 GROUP BY page""")
def line_pitch(spark, sf_dir):
    """Median distance of lines in font sizes (AGG-24)."""
    b = boxes(spark, sf_dir).withColumn("font", F.lit(4.0))
    return aggregates.line_pitch(b, ["page"], "y0", "font").select("page", F.round("pitch", 6).alias("pitch"))


@query()
def max_matching(spark, sf_dir):
    """Most pairs of reference and predicted boxes at IoU 0.1 (JN-03): one row a pair."""
    b = boxes(spark, sf_dir)
    moved = b.select("page", "id", G.box(F.col("x0") + F.col("size") % 9, F.col("y0") + F.col("size") % 5, F.col("x1") + F.col("size") % 9, F.col("y1") + F.col("size") % 5).alias("box"))
    return matching.match_most(joins.iou_candidates(b.select("page", "id", "box"), moved, ["page"], 0.1), ["page"]).withColumn("score", F.round("score", 6))


@query()
def optimal_assignment(spark, sf_dir):
    """The assignment of most pairs and then greatest IoU (JN-04)."""
    b = boxes(spark, sf_dir)
    moved = b.select("page", "id", G.box(F.col("x0") + F.col("size") % 9, F.col("y0") + F.col("size") % 5, F.col("x1") + F.col("size") % 9, F.col("y1") + F.col("size") % 5).alias("box"))
    return matching.match_best(joins.iou_candidates(b.select("page", "id", "box"), moved, ["page"], 0.1), ["page"]).withColumn("score", F.round("score", 6))


@query()
def greedy_match(spark, sf_dir):
    """First fit in order of ids (JN-05)."""
    b = boxes(spark, sf_dir)
    moved = b.select("page", "id", G.box(F.col("x0") + F.col("size") % 9, F.col("y0") + F.col("size") % 5, F.col("x1") + F.col("size") % 9, F.col("y1") + F.col("size") % 5).alias("box"))
    return matching.match_first(joins.iou_candidates(b.select("page", "id", "box"), moved, ["page"], 0.1), ["page"]).withColumn("score", F.round("score", 6))


@query()
def merged_regions(spark, sf_dir):
    """Overlapping boxes as growing unions (WIN-14, SET-06)."""
    return windows.merged_boxes(boxes(spark, sf_dir).select("page", F.col("id").cast("string").alias("id"), "x0", "y0", "x1", "y1"), ["page"])


@query()
def row_groups(spark, sf_dir):
    """Regions grouped to rows by centre (WIN-08)."""
    return windows.same_rows(boxes(spark, sf_dir).select("page", F.col("id").cast("string").alias("id"), "x0", "y0", "x1", "y1"), ["page"])


@query()
def word_chains(spark, sf_dir):
    """Unambiguous right-neighbour chains (WIN-10)."""
    b = boxes(spark, sf_dir).select("page", F.col("id").cast("string").alias("id"), "x0", F.col("y0"), (F.col("x0") + 35).alias("x1"), (F.col("y0") + 60).alias("y1"), "text")
    return windows.word_chains(b, ["page"])


@query()
def table_grid(spark, sf_dir):
    """Rows and columns of positioned lines (WIN-07)."""
    b = boxes(spark, sf_dir).select("page", F.col("id").cast("string").alias("id"), F.col("x0").alias("x"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.lit(440.0).alias("table_width"))
    return windows.table_grid(b, ["page"])


@query()
def ocr_paragraphs(spark, sf_dir):
    """Lines of one paragraph with their offsets (WIN-09)."""
    b = boxes(spark, sf_dir).select("page", "id", (F.col("x0") % 20).alias("x0"), "y0", F.lit(300.0).alias("x1"), (F.col("y0") + 14).alias("y1"), F.concat_ws(" ", "text", "text").alias("text"))
    return windows.paragraphs(b, ["page"])


@query()
def address_blocks(spark, sf_dir):
    """Lines of a postal block next to a found one (JN-18, PRJ-15)."""
    b = boxes(spark, sf_dir).select("page", "id", G.box(F.lit(40.0), F.col("y0"), F.lit(200.0), F.col("y0") + 12).alias("box"), F.concat(F.col("text"), F.lit(" "), F.col("size").cast("string")).alias("text"))
    return joins.address_block(b.where("text like 'red%'").select("page", "id"), b)


@query()
def paragraph_map(spark, sf_dir):
    """Paragraphs mapped to regions, ambiguous or unmatched (JN-11)."""
    b = boxes(spark, sf_dir)
    p = b.select("page", F.col("id").alias("paragraph_id"), G.box(F.col("x0") + 3, F.col("y0") + 1, F.col("x1") + 3, F.col("y1") + 1).alias("box"), "text")
    return joins.map_paragraphs(p, b.select("page", F.col("id").alias("region_id"), "box", "text"))
