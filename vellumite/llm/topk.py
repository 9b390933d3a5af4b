"""Operator 5: exact top-k search by dual traversal of cover trees.

Queries and data are each indexed by a cover tree: a node has a centre that is one of its points, and a radius that
covers all points below it; children of a node cover it with radii of half the size. A pair of nodes can be left out if
its best possible inner product, <cq, cr> + rq |cr| + rr |cq| + rq rr, is below the worst kth score that any query of the
group has so far. Queries go in blocks of bounded size; each task searches one block of the data at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.llm._shared import column, written

#: Queries that are broadcast at once, and rows of data that are indexed at once.
QUERY_BLOCK, DATA_BLOCK = 8192, 8192
#: Rows that are searched first, to begin with good kth scores.
SEED = 2048
LEAF = 32
LOWEST = -(2**63) + 2


class CoverTree:
    """Nodes by level, from the root; order is a permutation in which every node is a run of points."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        n = len(points)
        with np.errstate(over="ignore", invalid="ignore"):
            dist = np.linalg.norm(self.points - self.points[0], axis=1)
        if not np.isfinite(dist).all():  # beyond what can be measured: one node that covers everything
            dist = np.where(dist == 0, 0.0, np.inf)
            self.leaves, self.parents, self.levels = [np.arange(n)], [np.zeros(1, np.int64)], [(np.zeros(1, np.int64), np.array([np.inf]))]
            return
        order_groups = [(np.arange(n), 0, dist)]
        parents, raw = [np.zeros(1, np.int64)], [[self._node(0, dist)]]
        while any(len(g[0]) > LEAF and g[2].max() > 0 for g in order_groups):
            next_groups, next_nodes, parent = [], [], []
            for i, (members, c, d) in enumerate(order_groups):
                if len(members) <= LEAF or d.max() <= 0:
                    next_groups.append((members, c, d))
                    next_nodes.append(self._node(c, d))
                    parent.append(i)
                    continue
                for g in self._split(members, c, d):
                    next_groups.append(g)
                    next_nodes.append(self._node(g[1], g[2]))
                    parent.append(i)
            order_groups = next_groups
            raw.append(next_nodes)
            parents.append(np.array(parent))
        self.leaves = [g[0] for g in order_groups]
        self.parents = parents
        self.levels = [(np.array([c for c, _ in level]), np.array([r for _, r in level])) for level in raw]

    @staticmethod
    def _node(c: int, d: np.ndarray) -> tuple[int, float]:
        return c, float(d.max())

    def _split(self, members: np.ndarray, c: int, d: np.ndarray):
        """A net at half the radius: every centre further than that from the others, every point within it of one."""
        radius = d.max() / 2
        owner = np.zeros(len(members), np.int64)
        best, centres = d.copy(), [c]
        # in high dimensions a half as wide a net may need a node for nearly every point; a wider one covers as well
        most = max(8, int(np.sqrt(len(members))))
        while best.max() > radius and len(centres) < most:
            far = int(best.argmax())
            new = np.linalg.norm(self.points[members] - self.points[members[far]], axis=1)
            nearer = new < best
            owner[nearer], best[nearer] = len(centres), new[nearer]
            centres.append(int(members[far]))
        return [(members[owner == i], centre, best[owner == i]) for i, centre in enumerate(centres) if (owner == i).any()]


class Best:
    """The k best (score, then least id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), LOWEST, np.int64), np.full((n, k), 2**63 - 1, np.int64)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of each of rows with each of ids."""
        k = self.score.shape[1]
        s = np.hstack([self.score[rows], scores])
        i = np.hstack([self.id[rows], np.broadcast_to(ids, scores.shape)])
        by = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; those beyond a long are the nearest long."""
    with np.errstate(over="ignore"):
        bound = np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0)  # of every partial sum too
    if bound < 2**52:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62 and max(np.abs(a).max(), np.abs(b).max()) < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.clip(exact, LOWEST + 1, 2**63 - 1).astype(np.int64)


def search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, best: Best) -> None:
    """Fill best with the data's inner products, but for pairs of equal ids."""
    with np.errstate(over="ignore"):
        q_norm, r_norm = np.linalg.norm(queries.points, axis=1), np.linalg.norm(data.points, axis=1)
    q_last, r_last = len(queries.levels) - 1, len(data.levels) - 1
    group = [np.zeros(len(queries.points), np.int64) for _ in queries.levels]
    for i, leaf in enumerate(queries.leaves):
        at = i
        for level in range(q_last, -1, -1):
            group[level][leaf] = at
            at = queries.parents[level][at]
    floors = [_group_min(best.worst(), g, len(queries.levels[level][0])) for level, g in enumerate(group)]
    q, r, level_q, level_r = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while True:
        cq, rq = queries.levels[level_q][0][q], queries.levels[level_q][1][q]
        cr, rr = data.levels[level_r][0][r], data.levels[level_r][1][r]
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.concatenate([np.einsum("ij,ij->i", queries.points[cq[a : a + 65536]], data.points[cr[a : a + 65536]]) for a in range(0, len(q), 65536)] or [np.zeros(0)])
            most = most + rq * r_norm[cr] + rr * q_norm[cq] + rq * rr
            # rounding is small against the norms; what cannot be measured is kept
            most = most + 1 + 1e-9 * (q_norm[cq] + rq) * (r_norm[cr] + rr)
        most = np.where(np.isnan(most), np.inf, most)
        keep = most >= _low(floors[level_q][q])
        q, r, most = q[keep], r[keep], most[keep]
        if not len(q) or (level_q == q_last and level_r == r_last):
            break
        if level_r < r_last:
            q, r = _down(q, r, data.parents[level_r + 1])
            level_r += 1
        if level_q < q_last:
            r, q = _down(r, q, queries.parents[level_q + 1])
            level_q += 1
    # leaf pairs, the most promising first: later ones are held against what these have brought
    for node in np.unique(q):
        rows = queries.leaves[node]
        own = np.flatnonzero(q == node)
        own = own[np.argsort(-most[own])]
        for a in range(0, len(own), 32):
            some = own[a : a + 32]
            some = some[most[some] >= _low(best.worst()[rows].min())]
            if not len(some):
                break
            at = np.concatenate([data.leaves[x] for x in r[some]])
            scores = products(queries.points[rows], data.points[at])
            scores[query_ids[rows][:, None] == data_ids[at][None, :]] = LOWEST
            best.add(rows, scores, data_ids[at])


def _low(scores):
    """Whole scores as floating-point numbers that are not above them."""
    x = np.asarray(scores, np.float64)
    return x - 1e-9 * np.abs(x)


def _group_min(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, group, values)
    return out


def _down(keep: np.ndarray, node: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair with each of its node's children (parent is ascending)."""
    lo, hi = np.searchsorted(parent, node, "left"), np.searchsorted(parent, node, "right")
    n = hi - lo
    start = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else lo
    return np.repeat(keep, n), start + np.arange(int(n.sum()))


def _whole(vectors: pa.Array, dims: int) -> np.ndarray:
    return quantise(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)


def quantise(x) -> np.ndarray:
    """floor(256 x), as whole floating-point numbers."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(np.asarray(x, np.float64) * 256.0))


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as doubles, of the vectors that take part."""
    ok = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(cast(c as double)) < double('Infinity'))"
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


SCHEMA = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: of every vector whose id is divisible by `every` the k best of all other vectors.

    A vector that is null or empty, has no id, or holds a component that is null or not finite takes no part. Scores are
    exact inner products of floor(256 x); one beyond a long counts as the nearest long. Ties go to the smaller vec_id; of rows with one id, each is a candidate, and
    a query's own id none; repeated query rows are one query, the least of them. Vectors of other lengths than the query's
    are no candidates. Fewer others give fewer rows, an empty table none. Other columns are not read. A task gives k rows
    a query at most, and only what may still be among the best; these meet in one window by query."""
    spark = vectors.sparkSession
    all_rows = taking_part(vectors)
    queries = all_rows.where(f"vec_id % {every} = 0").groupBy("vec_id").agg(F.min("v").alias("v"))
    out = None
    for dims, n in sorted((r.d, r.n) for r in queries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()):
        of_size, data = queries.where(F.size("v") == dims), all_rows.where(F.size("v") == dims)
        blocks = -(-n // QUERY_BLOCK) if n <= QUERY_BLOCK else -(-2 * n // QUERY_BLOCK)  # hashed blocks vary in size
        seed = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEED).collect()
        for b in range(blocks):
            own = of_size if blocks == 1 else of_size.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
            own = own.orderBy("vec_id").collect()  # a block
            if not own:
                continue
            ids, points = np.array([r.vec_id for r in own]), quantise([r.v for r in own])
            first = Best(len(ids), k)
            tree = CoverTree(points)
            # seed rows only set the floor: the search itself meets every row, these too
            search(tree, ids, CoverTree(quantise([r.v for r in seed])), np.array([r.vec_id for r in seed]), first)
            sent = spark.sparkContext.broadcast((ids, tree, first.worst()))
            found = data.mapInArrow(_searcher(sent, k, dims), SCHEMA)
            if blocks > 1:  # a few rows a query; then the block is no longer needed
                found = written(found, "found")
                sent.destroy()
            out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], SCHEMA)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(sent, k: int, dims: int):
    def run(batches):
        ids, tree, floor = sent.value
        best = Best(len(ids), k)
        # the floor is a score that k rows reach: none below it can be among the best, one equal to it can
        best.score[:] = floor[:, None] - 1
        best.id[:] = -1

        def block(rows):
            vec_ids = np.concatenate([column(b, "vec_id").to_numpy() for b in rows])
            points = np.concatenate([_whole(column(b, "v"), dims) for b in rows])
            search(tree, ids, CoverTree(points), vec_ids, best)

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, DATA_BLOCK):
                part = batch.slice(at, DATA_BLOCK)
                held.append(part)
                n += part.num_rows
                if n >= DATA_BLOCK:
                    block(held)
                    held, n = [], 0
        if n:
            block(held)
        real = (best.score >= floor[:, None]) & (best.score > LOWEST)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(1))), pa.array(best.id[real]), pa.array(best.score[real])], ["query_id", "vec_id", "score"])

    return run
