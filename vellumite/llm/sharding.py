"""Operator 8 (native): k-d tree sharding, law `bytes`.

The points are groups of equal texts, each with the metadata of its least doc_id and the bytes of all its copies as
weight. A node that is to become m shards is split at the weighted quantile of the dimension in which it is widest against
the whole table (the weighted median where both halves want the same), until every leaf is one shard. The quantile comes
from distributed weight histograms: one over the dimension in BINS steps, then one over a hash order inside the step that
it falls into, which also breaks ties. Only the splits, at most shards - 1 of them, reach the driver; the tree becomes one
nested CASE expression.

Groups stay whole. Those above LARGE of a shard, of which there are at most shards / LARGE, are laid into shards first, the
heaviest into the emptiest; the tree then fills what is left of each shard. Only a group that is larger than a shard is
dealt out in pieces, no more of them than it needs.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.llm._shared import written

#: Steps of each histogram.
BINS = 4096
#: Groups above this share of a shard's target bytes are laid into shards before the tree is made.
LARGE = 1 / 16
#: Bytes that a row counts beside those of its text.
ROW_BYTES = 16
#: Rows that share one numbering of slots, about.
SLOT_ROWS = 128
SPREAD = 1 << 40
DIMENSIONS = ("at_doc", "at_size", "at_lang", "at_source")


def _code(c: Column) -> Column:
    """A place on a line for every category, from the whole string: categories become a dimension."""
    return F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(SPREAD)).cast("double")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as one literal."""
    names = [c.split()[0] for c in schema.split(", ")]
    body = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ", ".join(c.replace(" ", ": ", 1) for c in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(body), f"array<struct<{fields}>>")))


def sized(docs: DataFrame) -> DataFrame:
    """What sharding needs of every row: its size, checksum, group and metadata."""
    names = set(docs.columns)
    pick = lambda c, kind: (F.col(c) if c in names else F.lit(None)).cast(kind)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.hash(text).alias("g2"),
        _code(pick("lang", "string")).alias("lang"), _code(pick("source", "string")).alias("source"),
    )


def shards(docs: DataFrame, count: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    A null text counts as empty; null lang, source or doc_id sort first and lose no row. Repeated rows stay repeated rows
    with slots of their own. An empty table gives no rows. Columns beside doc_id, text, lang, source are not read. Texts,
    very long ones too, are read once and not shuffled. Equal texts share a shard unless they are more than one."""
    spark = docs.sparkSession
    rows = written(sized(docs), "sized")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    target = max(1.0, total / count)
    key = ["g1", "g2", "size"]
    groups = rows.groupBy(*key).agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "lang", "source")).alias("m"))
    groups = groups.withColumn("weight", (F.col("copies") * F.col("size")).cast("long"))
    is_large = F.col("weight") > F.lit(target * LARGE)
    heavy = [tuple(r) for r in groups.where(is_large).select(*key, "copies", "weight").collect()]  # count / LARGE at most
    laid, room = lay(heavy, target, count)
    large = _table(spark, laid, "g1 long, g2 int, size long, pieces int, piece int, shard int")
    points = written(groups.where(~is_large).select(*key, "weight", F.pmod(F.xxhash64(*key), F.lit(SPREAD)).alias("tie"), F.coalesce("m.doc_id", F.lit(-1)).cast("double").alias("at_doc"), F.log1p("size").alias("at_size"), F.col("m.lang").alias("at_lang"), F.col("m.source").alias("at_source")), "points")
    placed = points.select(*key, _tree(points, room).alias("leaf"))
    # count / LARGE + count rows at most: a proven bound for the broadcast. A piece holds the copies that their hash deals to it
    found = rows.join(F.broadcast(large.groupBy(*key).agg(F.first("pieces").alias("pieces"), F.map_from_entries(F.collect_list(F.struct("piece", "shard"))).alias("at"))), key, "left")
    piece = F.pmod(F.xxhash64("doc_id", "lang", "source"), F.col("pieces")).cast("int")
    dealt = found.where("pieces is not null").select(*rows.columns, F.element_at("at", piece).alias("shard"))
    dealt = dealt.union(found.where("pieces is null").select(*rows.columns).join(placed, key).select(*rows.columns, F.col("leaf").alias("shard")))
    return _slots(dealt, n, count).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def lay(heavy: list[tuple], target: float, count: int) -> tuple[list[tuple], list[float]]:
    """Where large groups (g1, g2, size, copies, weight) go, as (g1, g2, size, pieces, piece, shard); and the room left in each shard."""
    parts = []
    for *key, copies, weight in heavy:
        pieces = min(copies, math.ceil(weight / target))
        parts += [(weight / pieces, *key, pieces, k) for k in range(pieces)]
    full = [(0.0, shard) for shard in range(count)]
    laid = []
    for weight, *piece in sorted(parts, key=lambda x: (-x[0], x[1:])):
        at, shard = heapq.heappop(full)
        laid.append((*piece, shard))
        heapq.heappush(full, (at + weight, shard))
    room = [0.0] * count
    for at, shard in full:
        room[shard] = max(0.0, target - at)
    return laid, room


def _bin(d: Column, lo: Column, wide: Column) -> Column:
    return F.least(F.floor((d - lo) / wide * BINS), F.lit(BINS - 1)).cast("int")


def _tree(points: DataFrame, room: list[float]) -> Column:
    """The number of the leaf that a point falls into. A node is named by its first leaf and its number of leaves.

    A node's weight is shared out between its halves as the room of their leaves is."""
    count, splits = len(room), {}

    def share(first: int, m: int) -> float:
        return sum(room[first : first + m // 2]) / (sum(room[first : first + m]) or 1.0)

    fine_bin = F.floor(F.col("tie") / F.lit(SPREAD // BINS)).cast("int")

    def leaf_of(first: int, m: int) -> Column:
        if (first, m) not in splits:
            return F.lit(first)
        d, lo, wide, cut, sub = splits[first, m]
        b = _bin(F.col(d), F.lit(lo), F.lit(wide))
        return F.when((b > cut) | ((b == cut) & (fine_bin >= sub)), leaf_of(first + m // 2, m - m // 2)).otherwise(leaf_of(first, m // 2))

    level, spans = {0: count}, {}  # first leaf of each node of this level -> its number of leaves
    while level := {k: m for k, m in level.items() if m > 1}:
        at = points.withColumn("node", leaf_of(0, count)).where(F.col("node").isin(list(level)))
        extents = at.groupBy("node").agg(*(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))), F.sum("weight").alias("weight")).collect()  # a row a node
        if not extents:
            break
        box = {}
        for r in extents:
            width = {d: r[f"hi_{d}"] - r[f"lo_{d}"] for d in DIMENSIONS}
            spans = spans or {d: v or 1.0 for d, v in width.items()}
            d = max(DIMENSIONS, key=lambda d: width[d] / spans[d])
            box[r.node] = (d, r[f"lo_{d}"], width[d] or 1.0, r.weight * share(r.node, level[r.node]))
        # a row a node, fewer than the shards: a proven bound for the broadcast
        own = _table(points.sparkSession, [(k, DIMENSIONS.index(d) + 1, float(lo), float(wide)) for k, (d, lo, wide, _) in box.items()], "node int, dim int, lo double, wide double")
        at = at.join(F.broadcast(own), "node").withColumn("bin", _bin(F.element_at(F.array(*DIMENSIONS), F.col("dim")), F.col("lo"), F.col("wide")))
        coarse = _crossing(at.groupBy("node", "bin").agg(F.sum("weight").alias("w")), {k: v[3] for k, v in box.items()})
        cut = _table(points.sparkSession, [(k, r.bin) for k, r in coarse.items()], "node int, bin int")
        inside = at.join(F.broadcast(cut), ["node", "bin"])
        fine = _crossing(inside.withColumn("bin", fine_bin).groupBy("node", "bin").agg(F.sum("weight").alias("w")), {k: box[k][3] - r.below for k, r in coarse.items()})
        for k, (d, lo, wide, want) in box.items():
            r = fine[k]
            left = r.below + r.w / 2 < want - coarse[k].below  # the last step goes to the side that leaves the least error
            splits[k, level[k]] = d, lo, wide, coarse[k].bin, r.bin + (1 if left else 0)
        level = {first: m for k, n in level.items() for first, m in ((k, n // 2), (k + n // 2, n - n // 2))}
    return leaf_of(0, count)


def _crossing(bins: DataFrame, want: dict[int, float]):
    """Of every node the bin in which the summed weights pass what is wanted, with the weight below it."""
    w = W.partitionBy("node").orderBy("bin")  # at most BINS rows a node
    runs = bins.select("node", "bin", "w", (F.sum("w").over(w) - F.col("w")).alias("below"), F.row_number().over(W.partitionBy("node").orderBy(F.desc("bin"))).alias("last"))
    goal = _table(bins.sparkSession, [(k, float(v)) for k, v in want.items()], "node int, goal double")
    hit = runs.join(F.broadcast(goal), "node").where((F.col("below") + F.col("w") >= F.col("goal")) | (F.col("last") == 1))
    return {r.node: r for r in hit.groupBy("node").agg(F.min_by(F.struct("bin", "w", "below"), "bin").alias("s")).select("node", "s.*").collect()}


def _slots(rows: DataFrame, n: int, count: int) -> DataFrame:
    """Number the rows of each shard from 0 without gaps: runs by a hash, numbered inside, after the rows of earlier runs."""
    runs = max(1, math.ceil(n / (count * SLOT_ROWS)))
    run = F.pmod(F.xxhash64("doc_id", "g1", "lang", "source"), F.lit(runs)).cast("int")
    rows = written(rows.withColumn("run", run).select("doc_id", "size", "text_crc32", "shard", "run"), "dealt")
    sizes = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "run", (F.sum("n").over(W.partitionBy("shard").orderBy("run")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("inside", inside).join(before, ["shard", "run"]).withColumn("slot", (F.col("before") + F.col("inside")).cast("long"))
