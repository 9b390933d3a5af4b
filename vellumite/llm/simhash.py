"""Operator 10: SimHash near-dedup by a Gray-order hierarchical index.

Fingerprints that are distinct are sorted by their rank in the reflected Gray code, where neighbours share long bit
patterns. Over that order a tree is laid: a leaf is a run of fingerprints, and every node keeps the mask of bits that all
below it share and their pattern, of which only what its parent has not yet is compared. A search carries the
differences summed so far downwards and drops a whole group as soon as they exceed the bound.

To deal the work out, the 64 bits are cut in four: if at most two bits differ, two of the four parts agree. Each pair of
parts is a key (six rows a fingerprint); a key with more than BUCKET fingerprints is cut again over the 32 bits left in
three, one of which must agree. Within a bucket only links that join two classes are kept, so that a group of n near
copies gives n - 1 links instead of n squared; the classes are the same.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.llm._shared import column, written
from vellumite.llm.components import components

#: A key with more distinct fingerprints than this is cut further.
BUCKET = 2048
#: Fingerprints in a leaf of the index.
LEAF = 16
#: Children of an inner node.
FAN = 8
MAJORITY_ROWS = 255


def fingerprint(text: str | None, words: int = 3) -> int:
    """Of one text: bits set in over half of the XXH64 (seed 42) of its word shingles; 0 without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), 42)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)  # noqa: B905  starts has more
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes. Eight bits are counted at once in the bytes of a word."""
    n = len(hashes)
    ones = np.uint64(0x0101010101010101)
    cuts = np.arange(0, n, MAJORITY_ROWS)
    out = 0
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & ones, cuts)  # at most 255 in each byte
        counts = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)  # little endian: byte j is bit 8 j + bit
        for j in range(8):
            if 2 * int(counts[j]) > n:
                out |= 1 << (8 * j + bit)
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp), fp the fingerprint as a signed long, of every whole text (null: none)."""

    def run(batches):
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), words) for t in column(batch, "text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray code."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """A tree over distinct fingerprints in Gray order; see the module's text."""

    def __init__(self, values: np.ndarray):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        n = len(self.values)
        cuts = np.arange(0, n, LEAF)
        self.levels = [self._shared(np.bitwise_and.reduceat(self.values, cuts), np.bitwise_or.reduceat(self.values, cuts))]
        while len(cuts) > FAN:
            mask, pattern = self.levels[0]
            # a bit is shared above if it is shared in all children, with one pattern
            cuts = np.arange(0, len(mask), FAN)
            keep = np.bitwise_and.reduceat(mask, cuts)
            ands, ors = np.bitwise_and.reduceat(pattern, cuts), np.bitwise_or.reduceat(pattern, cuts)
            keep &= ~(ands ^ ors)
            self.levels.insert(0, (keep, ands & keep))
        for i in range(len(self.levels) - 1, 0, -1):  # what stands above is factored out below
            mask, pattern = self.levels[i]
            above = np.repeat(self.levels[i - 1][0], FAN)[: len(mask)]
            self.levels[i] = (mask & ~above, pattern & ~above)

    @staticmethod
    def _shared(ands: np.ndarray, ors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = ~(ands ^ ors)
        return mask, ands & mask

    def pairs(self, most: int, at_once: int = 512):
        """All pairs of places in self.values, the first less than the second, at `most` or fewer differing bits."""
        n = len(self.values)
        for lo in range(0, n, at_once):
            own = np.arange(lo, min(n, lo + at_once))
            roots = len(self.levels[0][0])
            q, node = np.repeat(own, roots), np.tile(np.arange(roots), len(own))
            diff = np.zeros(len(q), np.uint8)
            for depth, (mask, pattern) in enumerate(self.levels):
                diff = diff + np.bitwise_count((self.values[q] ^ pattern[node]) & mask[node])
                span = LEAF * FAN ** (len(self.levels) - 1 - depth)
                ok = (diff <= most) & ((node + 1) * span > q)
                q, node, diff = q[ok], node[ok], diff[ok]
                fan, limit = (FAN, len(self.levels[depth + 1][0])) if depth + 1 < len(self.levels) else (LEAF, n)
                q, diff = np.repeat(q, fan), np.repeat(diff, fan)
                node = (node[:, None] * fan + np.arange(fan)).ravel()
                ok = node < limit
                q, node, diff = q[ok], node[ok], diff[ok]
            ok = (node > q) & (np.bitwise_count(self.values[q] ^ self.values[node]) <= most)
            yield q[ok], node[ok]


def joining_links(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of all links among distinct values."""
    if len(values) < 2:
        return []
    index = GrayIndex(values)
    root = list(range(len(values)))
    out = []

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in index.pairs(most):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((x, y))
    v = index.values.view(np.int64)
    return [(int(v[x]), int(v[y])) for x, y in out]


PARTS = list(combinations(range(4), 2))


def _bits(x, at: int, n: int):
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << n) - 1))


def links(distinct: DataFrame, most: int = 2) -> DataFrame:
    """(a, b): links among the fingerprints fp of distinct that join all that reach each other at <= 2 bits a step."""
    if most > 2:
        raise ValueError("the keys serve two differing bits at most")
    fp = F.col("fp")
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), (_bits(fp, 16 * i, 16) * F.lit(65536) + _bits(fp, 16 * j, 16)).alias("key"))
        for k, (i, j) in enumerate(PARTS)
    ])).alias("e")).select("fp", "e.k", "e.key")
    sizes = keyed.groupBy("k", "key").count().where("count > 1")
    keyed = keyed.join(sizes, ["k", "key"])
    rest = F.lit(None)
    for k, (i, j) in enumerate(PARTS):
        p, q = (x for x in range(4) if x not in (i, j))
        left = _bits(fp, 16 * p, 16) * F.lit(65536) + _bits(fp, 16 * q, 16)
        rest = F.when(F.col("k") == k, left).otherwise(rest)
    cut = F.explode(F.when(F.col("count") > BUCKET, F.array(*[F.lit(c) * F.lit(1 << 12) + _bits(F.col("rest"), at, n) for c, (at, n) in enumerate(((0, 11), (11, 11), (22, 10)))])).otherwise(F.array(F.lit(-1).cast("long"))))
    keyed = keyed.withColumn("rest", rest).select("fp", "k", "key", cut.alias("sub"))

    def run(batches):
        key, held = None, []

        def done():
            if len(held) < 2:
                return []
            return joining_links(np.unique(np.array(held, np.int64)).view(np.uint64), most)

        for batch in batches:
            cols = [column(batch, c).to_numpy() for c in ("k", "key", "sub", "fp")]
            new = np.ones(batch.num_rows, bool)
            for c in cols[:3]:
                new[1:] &= c[1:] == c[:-1]
            edges = []
            cuts = [0, *(np.flatnonzero(~new[1:]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905
                now = tuple(int(c[lo]) for c in cols[:3])
                if now != key:
                    edges += done()
                    key, held = now, []
                held += cols[3][lo:hi].tolist()
            if edges:
                yield _edges(edges)
        if edges := done():
            yield _edges(edges)

    return keyed.repartition("k", "key", "sub").sortWithinPartitions("k", "key", "sub").mapInArrow(run, "a long, b long")


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links) of every row of docs.

    Rows with a null doc_id cannot be named: they get a fingerprint and a null component, and link nothing. A text that
    is null, empty or without words has fingerprint 0, linked like any other. Repeated rows give repeated rows in one
    component. An empty table gives no rows. Other columns are not read. Copies meet as one fingerprint before any pair
    is formed. Very long texts are read whole, one at a time."""
    prints = written(fingerprints(docs, words), "fingerprints")
    distinct = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = written(links(distinct, most), "links").distinct()
    # in terms of least doc_ids from here on, so that the root is the answer
    named = edges.join(distinct.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(distinct.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    roots = components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    found = distinct.join(roots, distinct.least == roots.node, "left").select("fp", F.coalesce("root", "least").alias("component"))
    hex16 = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(found, "fp", "left").select("doc_id", hex16.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
