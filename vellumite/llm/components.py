"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.llm._shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b) that has another one, root the least node it reaches.

    Each round writes its edges to the shared folder, so lineage stays short and a lost executor re-reads them. Nothing
    but the count and sum of the edges comes to the driver. Nodes may be of any orderable integer type. The hub of a
    star is aggregated by min, so that a node with very many neighbours needs no task that holds them all; where rows
    meet their hub's minimum again, the join can be split. Loops and repeated edges are allowed."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:  # every round brings nodes nearer to their root: some log n squared of them at most
        # large star: every larger neighbour of a node is tied to the least of the node and its neighbours
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = written(small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.union(now.select("b", "b")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
