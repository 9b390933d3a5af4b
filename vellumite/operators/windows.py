"""Order-dependent operators: islands, packing, running counts, numbering, chains.

What a running window can say is a window. What depends on earlier choices runs in Arrow groups of one page or document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text as T


def islands(df: DataFrame, keys: list[str], order: list, new: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: `new` says of a row, by columns that may use lag over the order, whether it begins one."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_new")


def peak_concurrency(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The most spans open at once; at one time, ends come before starts."""
    points = spans.select(*keys, F.col(start).alias("t"), F.lit(1).alias("d")).union(spans.select(*keys, F.col(end), F.lit(-1)))
    # equal (time, step) rows are summed first: the running sum then has one row for them
    p = points.groupBy(*keys, "t", "d").agg(F.sum("d").alias("s"))
    w = W.partitionBy(*keys).orderBy("t", "d").rowsBetween(W.unboundedPreceding, 0)
    return p.withColumn("open", F.sum("s").over(w)).groupBy(*keys).agg(F.greatest(F.lit(0), F.max("open")).alias("peak"))


def word_lines(words: DataFrame, keys: list[str], gap: float = 3.0) -> DataFrame:
    """Lines of words: a new one where the top is more than `gap` from the word's before, in the order of (top, x0)."""
    w = W.partitionBy(*keys).orderBy("top", "x0")
    return islands(words, keys, ["top", "x0"], F.abs(F.col("top") - F.lag("top").over(w)) > gap, "line")


def line_blocks(lines: DataFrame, keys: list[str], gap: float = 8.0) -> DataFrame:
    """Blocks of lines (keys, line, top, bottom): a new one where the top is more than `gap` below the line before."""
    w = W.partitionBy(*keys).orderBy("line")
    return islands(lines, keys, ["line"], F.col("top") - F.lag("bottom").over(w) > gap, "block")


def pack(boxes: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Join boxes that follow within `gap` of the lowest edge so far of their group: one box for each."""
    w = W.partitionBy(*keys).orderBy("y0", "y1", "x0")
    lowest = F.max("y1").over(w.rowsBetween(W.unboundedPreceding, -1))
    g = islands(boxes, keys, ["y0", "y1", "x0"], F.col("y0") - lowest > gap, "group")
    return g.groupBy(*keys, "group").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def content_runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive pixel rows that are not blank: first, last."""
    full = rows.where("not blank")
    w = W.partitionBy(*keys).orderBy("row")
    g = full.withColumn("_g", F.col("row") - F.row_number().over(w))
    return g.groupBy(*keys, "_g").agg(F.min("row").alias("first"), F.max("row").alias("last")).drop("_g")


def clusters(df: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """Values in one dimension whose neighbours are within `threshold`: mean and size of each cluster."""
    w = W.partitionBy(*keys).orderBy(value)
    g = islands(df, keys, [value], F.col(value) - F.lag(value).over(w) > threshold, "cluster")
    return g.groupBy(*keys, "cluster").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def _grouped(df: DataFrame, keys: list[str], schema: str, solve) -> DataFrame:
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = solve(pdf.to_dict("records"))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return df.groupBy(*keys).applyInPandas(run, f"{head}, {schema}")


def table_grid(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Row and column of positioned lines (x, cx, cy, table_width): columns by clusters of x, rows by a moving anchor."""

    def solve(rows):
        width = rows[0]["table_width"]
        xs: list[list[float]] = []
        for x in sorted(r["x"] for r in rows):
            if xs and x - xs[-1][-1] <= width / 8:
                xs[-1].append(x)
            else:
                xs.append([x])
        columns = [sum(c) / len(c) for c in xs]
        anchors: list[list[float]] = []
        for cy in sorted(r["cy"] for r in rows):
            if anchors and abs(cy - sum(anchors[-1]) / len(anchors[-1])) <= 4:
                anchors[-1].append(cy)
            else:
                anchors.append([cy])
        means = [sum(a) / len(a) for a in anchors]
        nearest = lambda v, at: min(range(len(at)), key=lambda i: (abs(at[i] - v), i))
        return [(r["id"], nearest(r["cy"], means), nearest(r["x"], columns)) for r in rows]

    return _grouped(lines, keys, "id string, row int, column int", solve)


def same_rows(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of regions (id, x0, y0, x1, y1): one joins the nearest row whose first member's centre is close enough.

    Returns the row and the place in it from the left; regions without height are left out."""

    def solve(items):
        rows: list[dict] = []
        for r in sorted(items, key=lambda r: (r["y0"], r["x0"])):
            tall, centre = r["y1"] - r["y0"], (r["y0"] + r["y1"]) / 2
            if tall <= 0:
                continue
            near = [w for w in rows if abs(centre - w["centre"]) <= 0.4 * min(tall, w["tall"])]
            if near:
                min(near, key=lambda w: abs(centre - w["centre"]))["members"].append(r)
            else:
                rows.append({"centre": centre, "tall": tall, "members": [r]})
        return [(r["id"], i, j) for i, w in enumerate(rows) for j, r in enumerate(sorted(w["members"], key=lambda r: r["x0"]))]

    return _grouped(regions, keys, "id string, row int, place int", solve)


def paragraphs(lines: DataFrame, keys: list[str], least_words: int = 3) -> DataFrame:
    """Lines (id, x0, y0, x1, y1, text) of one paragraph: paragraph number, and the line's offset in its joined text."""
    w = W.partitionBy(*keys).orderBy("y0", "x0")
    prev = lambda c: F.lag(c).over(w)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    tall = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    d = lines.where(F.trim("text") != "").withColumn("_w", words).withColumn("_h", tall)
    h = F.greatest(F.col("_h"), prev("_h"))
    joins = (F.col("_w") >= least_words) & (prev("_w") >= least_words) & (F.col("y0") - prev("y1")).between(0, 0.8 * h) & (F.abs(F.col("x0") - prev("x0")) <= 0.6 * h)
    joins &= F.least("x1", prev("x1")) - F.greatest("x0", prev("x0")) >= 0.5 * F.least(F.col("x1") - F.col("x0"), prev("x1") - prev("x0"))
    d = islands(d, keys, ["y0", "x0"], ~joins, "paragraph")
    inner = W.partitionBy(*keys, "paragraph").orderBy("y0", "x0")
    offset = F.coalesce(F.sum(F.length("text") + 1).over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.select(*keys, "id", "paragraph", offset.cast("int").alias("offset"))


def word_chains(words: DataFrame, keys: list[str]) -> DataFrame:
    """Chains of word fragments where each has one right neighbour only and that has one left neighbour only."""

    def solve(rows):
        n = len(rows)
        right: dict[int, list[int]] = {i: [] for i in range(n)}
        left: dict[int, list[int]] = {i: [] for i in range(n)}
        by_x = sorted(range(n), key=lambda i: rows[i]["x0"])
        for i in range(n):
            a = rows[i]
            ha = a["y1"] - a["y0"]
            for j in by_x:
                b = rows[j]
                hb = b["y1"] - b["y0"]
                if i == j or min(ha, hb) <= 0 or not 0 <= b["x0"] - a["x1"] <= 0.28 * min(ha, hb) or not 0.8 <= ha / hb <= 1.25:
                    continue
                level = abs((a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2) <= 0.15 * max(ha, hb)
                if level and min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]) >= 0.75 * min(ha, hb):
                    right[i].append(j)
                    left[j].append(i)
        out, used = [], set()
        for i in range(n):
            if i in used or left[i]:
                continue
            chain = [i]
            while len(right[chain[-1]]) == 1 and (j := right[chain[-1]][0]) not in used and j not in chain and len(left[j]) == 1:
                chain.append(j)
            if len(chain) > 1 and len(" ".join(rows[j]["text"] for j in chain)) <= 1500:
                used.update(chain)
                out += [(rows[j]["id"], rows[i]["id"], k) for k, j in enumerate(chain)]
        return out

    return _grouped(words, keys, "id string, head string, place int", solve)


def merged_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes that overlap become one, and their union may reach others, until nothing changes: id and its group's first id."""

    def solve(rows):
        groups: list[dict] = []
        meets = lambda a, b: min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])
        for r in rows:
            box, members = (r["x0"], r["y0"], r["x1"], r["y1"]), [r["id"]]
            if box[2] > box[0] and box[3] > box[1]:
                while hit := [g for g in groups if meets(g["box"], box)]:
                    groups = [g for g in groups if g not in hit]
                    for g in hit:
                        box = (min(box[0], g["box"][0]), min(box[1], g["box"][1]), max(box[2], g["box"][2]), max(box[3], g["box"][3]))
                    members = [m for g in hit for m in g["members"]] + members
            groups.append({"box": box, "members": members})
        return [(m, g["members"][0], *map(float, g["box"])) for g in groups for m in g["members"]]

    return _grouped(boxes, keys, "id string, first_id string, x0 double, y0 double, x1 double, y1 double", solve)


def keep_first(elements: DataFrame, keys: list[str], order: list[str], chars: int = 100) -> DataFrame:
    """The first of elements that agree in keys and their first characters, in order."""
    w = W.partitionBy(*keys, F.substring("text", 1, chars)).orderBy(*order)
    return elements.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def carried_heading(elements: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each image with the last step or heading before it that no earlier image has taken."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    step = (F.col("kind") == "text") & F.col("text").rlike(r"^(?:#{1,3} |\d+[.)] )")
    d = elements.withColumn("_s", F.last(F.when(step, F.col("text")), True).over(w))
    # an image takes what stands since the image before it
    since = F.last(F.when(step, F.lit("step")).when(F.col("kind") == "image", F.lit("image")), True).over(w)
    return d.withColumn("heading", F.when((F.col("kind") == "image") & (since == "step"), F.col("_s"))).drop("_s")


def first_headings(regions: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """The first regions of each unit by (y, x)."""
    w = W.partitionBy(*keys).orderBy("y0", "x0", "id")
    return regions.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


# What a placeholder of each category is called.
PSEUDONYMS = {"Names": "Person", "Email addresses": "Email", "Phone numbers": "Phone", "Addresses": "Address", "Identifiers": "ID", "Bank accounts": "Account", "Dates of birth": "Birth date"}
LABELS = {"Names": "NAME", "Email addresses": "EMAIL", "Phone numbers": "PHONE", "Addresses": "ADDRESS", "Identifiers": "ID", "Bank accounts": "ACCOUNT", "Dates of birth": "BIRTH DATE"}


def _letters(n: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA."""
    one, two = F.char(65 + n % 26), F.concat(F.char((64 + F.floor(n / 26)).cast("int")), F.char(65 + n % 26))
    return F.when(n < 26, one).otherwise(two)


def pseudonyms(findings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, value, label: one placeholder for each distinct value, numbered in order of first appearance.

    Values that agree but for case and blanks share one. Names are served with the most words first, and a single word
    of a full name takes that person's."""
    v = findings.groupBy(*keys, "value").agg(F.min_by("category", order).alias("category"), F.min(order).alias("_first"))
    v = v.withColumn("_key", T.score_compact(F.col("value"))).withColumn("_words", F.size(F.split(F.trim("value"), r"\s+")))
    rank = F.when(F.col("category") == "Names", -F.col("_words")).otherwise(0)
    # the first of equal keys stands for all
    heads = v.groupBy(*keys, "category", "_key").agg(F.min(F.struct(rank.alias("r"), F.col("_first").alias("f"), F.col("value").alias("v"))).alias("h")).select(*keys, "category", "_key", "h.*")
    full = heads.where("category = 'Names' and r < -1").select(*keys, F.col("_key").alias("_owner"), F.explode(F.transform(F.split("v", r"\s+"), lambda x: F.regexp_replace(x, "^[,.]+|[,.]+$", ""))).alias("w"), F.col("r").alias("or"), F.col("f").alias("of")).select(*keys, T.casefold(F.col("w")).alias("w"), "_owner", "or", "of")
    owner = full.groupBy(*keys, "w").agg(F.min_by("_owner", F.struct("or", "of")).alias("_owner"))
    single = heads.withColumn("w", F.when((F.col("r") == -1) & (F.col("category") == "Names"), F.col("_key"))).join(owner, [*keys, "w"], "left").select(*keys, "category", "_key", "r", "f", "_owner")
    numbered = single.where("_owner is null").withColumn("n", F.row_number().over(W.partitionBy(*keys, "category").orderBy("r", "f", "_key")) - 1)
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PSEUDONYMS.items() for x in kv)), F.col("category")), F.lit("Item"))
    label = F.when(F.col("category") == "Names", F.concat(F.lit("Person "), _letters(F.col("n")))).otherwise(F.concat_ws(" ", kind, (F.col("n") + 1).cast("string")))
    own = numbered.select(*keys, "category", "_key", label.alias("label"))
    borrowed = single.where("_owner is not null").select(*keys, "category", "_key", "_owner").join(own.where("category = 'Names'").select(*keys, F.col("_key").alias("_owner"), "label"), [*keys, "_owner"]).select(*keys, "category", "_key", "label")
    return v.join(own.union(borrowed), [*keys, "category", "_key"]).select(*keys, "value", "category", "label")


def category_label(category: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.concat(F.lit("["), F.coalesce(F.element_at(m, category), F.lit("REDACTED")), F.lit("]"))


def stage_durations(events: DataFrame, keys: list[str], time: str, stage: str) -> DataFrame:
    """Seconds from each event to the next one of its key; the last has none."""
    w = W.partitionBy(*keys).orderBy(time, stage)
    return events.select(*keys, stage, time, (F.unix_micros(F.lead(time).over(w)) - F.unix_micros(F.col(time))).alias("micros")).withColumn("seconds", F.col("micros") / 1e6).drop("micros")


def text_slots(cells: DataFrame, keys: list[str], padding: float, gap: float) -> DataFrame:
    """Vertical slots of equal height for the texts of one cell, or null where they would not be apart."""
    n, h = F.count("*").over(W.partitionBy(*keys)), F.col("cell_height") - 2 * padding
    slot = (h - gap * (n - 1)) / n
    k = F.row_number().over(W.partitionBy(*keys).orderBy("y0", "id")) - 1
    top = F.col("cell_top") + padding + k * (slot + gap)
    return cells.select(*keys, "id", F.when(slot > 0, top).alias("slot_top"), F.when(slot > 0, slot).alias("slot_height"))


def claim_first(jobs: DataFrame, running: DataFrame, worker: str, order: list[str]) -> DataFrame:
    """The first queued job of each worker that has none running."""
    free = jobs.where("status = 'queued'").join(running.select(worker).distinct(), worker, "left_anti")
    w = W.partitionBy(worker).orderBy(*order)
    return free.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sessions(events: DataFrame, keys: list[str], time: str, gap_seconds: int) -> DataFrame:
    """Runs of events with less than a gap between them: start, end, n."""
    w = W.partitionBy(*keys).orderBy(time)
    new = F.unix_micros(F.col(time)) - F.unix_micros(F.lag(time).over(w)) > gap_seconds * 1_000_000
    return islands(events, keys, [time], new, "session").groupBy(*keys, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))


def debounced(events: DataFrame, keys: list[str], time: str, stage: str, every_seconds: int) -> DataFrame:
    """Events that change the stage, or come `every_seconds` after the last one that was sent."""

    def solve(rows):
        sent_at, sent_stage, out = None, None, []
        for r in sorted(rows, key=lambda r: (r["_t"], r["event_id"])):
            if sent_at is None or r[stage] != sent_stage or r["_t"] - sent_at >= every_seconds * 1_000_000:
                sent_at, sent_stage = r["_t"], r[stage]
                out.append((r["event_id"],))
        return out

    return _grouped(events.select(*keys, "event_id", stage, F.unix_micros(F.col(time).cast("timestamp")).alias("_t")), keys, "event_id long", solve)
