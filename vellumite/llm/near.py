"""Operator 10 at a similarity of word shingles: documents whose sets have a Jaccard similarity of at least `share`.

First the Gray-order index of simhash.py joins fingerprints over the same shingles at two bits; each pair is verified on
its sets. That finds most near copies cheaply, but sets at 0.8 often differ in ten bits and more, at which no index of
fingerprints prunes. What it has left apart goes into an exact prefix-filter join.

All shingles are put in one order. Two sets of similarity t or more share at least ceil(t n) shingles, n the size of
either, so the first n - ceil(t n) + 1 of each have one in common: these are its keys, and the candidate search loses
nothing. Any order that is the same for all documents will do. This one is by hash, save that shingles found often in a
sample of the documents come last, so that few documents meet only in a common line.

The place of a key in its set bounds what two sets can share: if they meet first in the i-th key of the one and the j-th
of the other, counted from 0, they share no more than min(n - i, m - j) shingles, and sets of similarity t share t / (1 + t)
(n + m) of them. So a key joins two sets only if its places allow that; the first key in common of two similar sets does.
Near copies of one text with a few changes each have those before the shingles that all of them share, and mostly too many.

Equal sets meet as one digest first. The sets are not stored; they are hashed again where they are needed. In the first
rounds the sets of a key meet only one pivot of the key, first the one that has the key at the least place: of near copies
of a text, one with the fewest changes, which most are similar to. Only pairs that are in different components after these
rounds are taken one by one; of these, pairs with too few keys in common to reach t are not compared. The components are the same. Every link is verified by counting shared shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.llm import simhash
from vellumite.llm._shared import Rolling, chunks, column, delete_path, words, written
from vellumite.llm.components import components
from vellumite.llm.decontaminate import LOWER, _counts

#: One document in so many is sampled for common shingles; a shingle in FREQUENT sampled ones comes last in the order.
SAMPLE, FREQUENT = 16, 3
#: Common shingles that are sent out at most. The order, not the result, depends on it.
MOST_COMMON = 1 << 18
#: Bits of the filter that tells, but for some too many, the documents to be compared.
FILTER_BITS = 24
#: Rounds in which the sets of a key meet one pivot.
ROUNDS = 2


class Shingler:
    """Distinct 64-bit hashes, in order, of the k-word shingles of each text (A-Z in lower case; fewer words: the whole sequence)."""

    def __init__(self, k: int):
        self.k = k
        self.word_hash, self.run_hash = Rolling(211), Rolling(223)

    def __call__(self, data: np.ndarray, offs: np.ndarray):
        data = LOWER[data]
        s, e, before = words(data, offs)
        n = np.diff(before)
        if not len(s):
            return [np.zeros(0, np.uint64)] * len(n)
        runs = self.run_hash.prefix(self.word_hash.between(self.word_hash.prefix(data), s, e))
        size = np.where(n >= self.k, n - self.k + 1, (n > 0).astype(np.int64))
        first = np.repeat(before[:-1], size) + _counts(size)
        hashes = self.run_hash.between(runs, first, first + np.repeat(np.minimum(n, self.k), size))
        return [np.unique(x) for x in np.split(hashes, np.cumsum(size)[:-1])]


def _sets(batches, k: int, *names: str):
    """Runs of rows: the values of the named columns as arrays, and for each row the set's digest and its hashes."""
    own = Shingler(k)
    for batch in batches:
        for lo, hi, data, offs in chunks(column(batch, "text")):
            sets = own(data, offs)
            digests = np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes(), 7) for x in sets), np.uint64, len(sets)).view(np.int64)
            yield [column(batch, c).slice(lo, hi - lo) for c in names], digests, sets


def _batch(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)


def _facts(docs: DataFrame, k: int) -> DataFrame:
    """id, h (digest of the set), n, fp (fingerprint) of every row."""

    def run(batches):
        for (ids, texts), h, sets in _sets(batches, k, "id", "text"):
            fp = np.fromiter((simhash.fingerprint(t.as_py(), k) for t in texts), np.uint64, len(sets))
            yield _batch(["id", "h", "n", "fp"], ids, h, np.array([len(x) for x in sets], np.int64), fp.view(np.int64))

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, h long, n long, fp long")


def _close_fingerprints(facts: DataFrame) -> DataFrame:
    """(a, b) of sets whose fingerprints are equal, or linked by the index: enough of them to join all that reach each other."""
    own = facts.groupBy("h").agg(F.min("fp").alias("fp"))
    first = own.groupBy("fp").agg(F.min("h").alias("rep"))
    same = own.join(first, "fp").where("h <> rep").select("h", "rep")
    near = simhash.links(first.select("fp")).distinct()
    far = near.join(first.select(F.col("fp").alias("a"), F.col("rep").alias("h")), "a").join(first.select(F.col("fp").alias("b"), "rep"), "b").select("h", "rep")
    return same.union(far).select(F.least("h", "rep").alias("a"), F.greatest("h", "rep").alias("b")).distinct()


def _common(texts: DataFrame, k: int) -> np.ndarray:
    """The shingles that many sampled documents have, the most common last."""

    def run(batches):
        for _, _, sets in _sets(batches, k):
            yield _batch(["key"], (np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64))

    part = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(run, "key long")
    rows = part.groupBy("key").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "key").limit(MOST_COMMON).select("key").toArrow()
    return rows["key"].to_numpy().view(np.uint64)[::-1].copy()


def needed(n: int, share: float) -> int:
    return math.ceil(share * n - 1e-9)


def prefix(hashes: np.ndarray, n: int, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n of hashes, which are sorted, with those of common (sorted, at the places rank of the order) last."""
    if not len(common):
        return hashes[:n]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    last = common[at] == hashes
    rare = hashes[~last]
    if len(rare) >= n:
        return rare[:n]
    return np.concatenate([rare, hashes[last][np.argsort(rank[at[last]])][: n - len(rare)]])


def _keys(texts: DataFrame, k: int, share: float) -> DataFrame:
    """key, h, i: the keys of every set and their places in its order, from 0."""
    common = _common(texts, k)
    place = np.argsort(common)
    sent = texts.sparkSession.sparkContext.broadcast((common[place], place))

    def run(batches):
        common, rank = sent.value
        for _, h, sets in _sets(batches, k):
            keys = [prefix(x, len(x) - needed(len(x), share) + 1, common, rank) for x in sets]  # an empty set has none
            size = np.array([len(x) for x in keys], np.int64)
            yield _batch(["key", "h", "i"], np.concatenate(keys).view(np.int64), np.repeat(h, size), _counts(size))

    return texts.mapInArrow(run, "key long, h long, i long")


def _shared(keys: DataFrame) -> DataFrame:
    """The distinct rows of those keys that two sets have."""

    def run(batches):
        key, h, place = (np.zeros(0, np.int64) for _ in range(3))

        def done(key, h, place):
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            key, h, place = key[new], h[new], place[new]
            same = key[1:] == key[:-1]
            several = np.zeros(len(key), bool)
            several[1:] |= same
            several[:-1] |= same
            return _batch(["key", "h", "i"], key[several], h[several], place[several])

        for batch in batches:
            key = np.concatenate([key, column(batch, "key").to_numpy()])
            h = np.concatenate([h, column(batch, "h").to_numpy()])
            place = np.concatenate([place, column(batch, "i").to_numpy()])
            cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0  # the last key may go on
            if cut:
                yield done(key[:cut], h[:cut], place[:cut])
                key, h, place = key[cut:], h[cut:], place[cut:]
        yield done(key, h, place)

    return keys.repartition("key").sortWithinPartitions("key", "h").mapInArrow(run, "key long, h long, i long")


def _used(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """h, hashes of the sets in wanted(h), once each."""
    bit = F.pmod(F.col("h"), F.lit(1 << FILTER_BITS))
    found = wanted.groupBy(F.floor(bit / 64).cast("int").alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(h, {1 << FILTER_BITS}), 64) as int))")).alias("w")).toArrow()
    table = np.zeros(1 << FILTER_BITS - 6, np.int64)
    table[found["i"].to_numpy()] = found["w"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches):
        for _, h, sets in _sets(batches, k):
            at = h & ((1 << FILTER_BITS) - 1)
            on = np.flatnonzero(sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            yield _batch(["h", "hashes"], h[on], pa.array([sets[i].tobytes() for i in on], pa.binary()))

    return texts.mapInArrow(run, "h long, hashes binary").join(wanted, "h", "left_semi").dropDuplicates(["h"])


def _verified(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) of digests whose sets are similar."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(column(batch, "ha"), column(batch, "hb"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= share * (len(p) + len(q) - both) - 1e-9)
            yield _batch(["a", "b"], column(batch, "a"), column(batch, "b")).filter(pa.array(good, pa.bool_()))

    a = sets.select(F.col("h").alias("a"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("h").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _roots(texts: DataFrame, facts: DataFrame, k: int, share: float) -> DataFrame:
    """(h, root) of every set that reaches another one."""
    temporary = []

    def kept(df, name):
        temporary.append(written(df, name))
        return temporary[-1]

    shared = kept(_shared(_keys(texts, k, share)), "keys")
    keys = kept(shared.join(facts.select("h", "n").distinct(), "h"), "sized_keys")
    close = F.least("n", "m") >= F.lit(share) * F.greatest("n", "m") - 1e-9
    least = F.lit(share / (1 + share)) * (F.col("n") + F.col("m")) - 1e-6  # shingles that similar sets share
    early = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= least
    # besides the keys in common, the sets share no more than what one of them has behind its keys
    enough = F.size(F.array_intersect("ka", "kb")) + F.ceil(F.lit(share) * F.greatest("n", "m") - 1e-9) - 1 >= least
    lists = kept(keys.groupBy("h").agg(F.collect_list("key").alias("k"), F.first("n").alias("n")), "key_lists")

    def counted(pairs):
        a = lists.select(F.col("h").alias("a"), F.col("k").alias("ka"), "n")
        b = lists.select(F.col("h").alias("b"), F.col("k").alias("kb"), F.col("n").alias("m"))
        return pairs.join(a, "a").join(b, "b").where(enough).select("a", "b")

    def similar(pairs):
        used = kept(_used(texts, pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), k), "sets")
        return kept(_verified(pairs, used, share), "similar")

    def rooted(edges):
        roots = written(components(edges).withColumnRenamed("node", "h"), "roots")
        return roots, keys.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))

    edges = similar(kept(_close_fingerprints(facts), "close"))
    now = kept(rooted(edges)[1], "rooted_keys")
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:  # with a pivot
            first = [F.col("i")] if turn == 0 else []
            pivot = now.groupBy("key").agg(F.min(F.struct(*first, F.xxhash64("h", F.lit(turn)).alias("x"), "h", "n", "root", F.col("i").alias("j"))).alias("p"))
            other = pivot.select("key", F.col("p.h").alias("other"), F.col("p.n").alias("m"), F.col("p.j").alias("j"), F.col("p.root").alias("other_root"))
            pairs = now.join(other, "key").where(F.col("root") != F.col("other_root"))
        else:  # all that are apart
            apart = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
            left = kept(now.join(apart, "key"), "open_keys")
            other = left.select("key", F.col("h").alias("other"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("other_root"))
            pairs = left.join(other, "key").where(F.col("root") < F.col("other_root"))
        pairs = pairs.where(close & early).select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct()
        edges = edges.union(similar(kept(counted(pairs), "pairs")))
        roots, now = rooted(edges)
        if turn < ROUNDS:
            now = kept(now, "rooted_keys")
    for df in temporary:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_path(df.sparkSession, path)
    return roots


def grouped(docs: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """id, component (a long) of every row of docs(id, text), one for all that reach each other over pairs at `share`.

    Shingles are k words ([^\\x20\\x09-\\x0D]+, A-Z in lower case); a text of fewer words is one shingle, and texts that are
    null, empty or without words are alike. Shingles, and whole sets, are told equal by 64 bits of hash. Ids may be null
    or repeated, of any type; repeated rows give repeated rows. An empty table gives no rows; other columns are not read."""
    docs = docs.select("id", F.col("text").cast("string").alias("text"))
    facts = written(_facts(docs, k), "facts")
    roots = _roots(docs.select("text"), facts, k, share)
    return facts.join(roots, "h", "left").select("id", F.coalesce("root", "h").alias("component"))
