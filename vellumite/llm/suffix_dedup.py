"""Operator 1: suffix-array dedup of byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Which suffixes meet in one transform is decided by anchors: of the ANCHOR-byte strings in a window of `least` bytes, the
one of least hash. Equal windows have equal anchors, so an anchor that occurs once stands for windows that occur once.
The stretches of bytes around repeated anchors are sent to the bucket of their anchor, equal stretches as one. In a
bucket the stretches are joined with a separator and sorted as suffixes; breadth-first backward extension on the transform
then derives the lengths of the common prefixes of neighbours by increasing value: the intervals of all strings of length
l give, by one step of the LF mapping for every character in them, those of length l + 1, and a border that appears first
at length l has the value l. At `least` the expansion stops: neighbours without a border by then share `least` bytes.

Only stretches that have the core of a class of windows, all but STEP - 1 of their bytes, in common with another one of
their bucket are sent into the transform: the rest cannot share a window.

A bucket that holds more than HOT different stretches is dealt out further: windows at up to STEP neighbouring places
before the anchor have all but STEP - 1 of their bytes in common, and these are the new key. What is larger even then is
decided by grouping single windows exactly.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.llm._shared import Rolling, anchors, chunks, column, of_several, written

LEAST, ANCHOR = 400, 48
#: Different stretches of one anchor that one transform takes: below 4096 times 753 bytes, 3 MB.
HOT = 4096
#: Windows that are kept together when a larger bucket is dealt out by what they have in common.
STEP = 44
#: Bytes at which a transform takes no further bucket.
BLOCK = 1 << 19
#: No UTF-8 text has this byte.
SEPARATOR = 0xFF


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first `depth` bytes at least (prefix doubling, ties by place)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        np.left_shift(key, np.uint64(8), out=key)
        np.bitwise_or(key, padded[i : i + n], out=key)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del key, padded
    start = np.flatnonzero(new).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))  # of equal suffixes, the first place
    del start
    h = 8
    while h < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        del tied
        if not len(at):
            break
        suffix = order[at]
        second = np.where(suffix < n - h, rank[np.minimum(suffix, n - h - 1) + h] + 1, 0)
        both = rank[suffix].astype(np.int64) * (n + 1) + second
        by = np.argsort(both, kind="stable")
        suffix, both = suffix[by], both[by]
        order[at] = suffix
        fresh = np.ones(len(at), bool)
        fresh[1:] = both[1:] != both[:-1]
        new[at] = fresh
        rank[suffix] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        h *= 2
    return order


def common_prefix_borders(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Of every place in order, whether its suffix shares fewer than `least` bytes, free of separators, with the one before."""
    n = len(text)
    bwt = text[order - 1]  # of the suffix at 0 the last byte, a separator
    to_l = np.argsort(bwt, kind="stable").astype(np.int32)
    same = np.diff(bwt[to_l]) == 0
    lf = np.empty(n, np.int32)
    lf[to_l] = np.arange(n, dtype=np.int32)
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[to_l[1:][same]] = to_l[:-1][same]
    after[to_l[:-1][same]] = to_l[1:][same]
    extends = bwt != SEPARATOR
    del to_l, bwt
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    # strings of one character, the separator too, of which only extensions to the left are followed
    lo = np.flatnonzero(np.append(True, ~same)).astype(np.int64)
    hi = np.append(lo[1:], n)
    border[hi] = True
    for _ in range(1, least):
        size = hi - lo
        total = int(size.sum())
        if not total:
            break
        base = np.cumsum(size) - size
        at = np.repeat(lo - base, size) + np.arange(total)
        use = extends[at]
        first = use & (before[at] < np.repeat(lo, size))
        last = use & (after[at] >= np.repeat(hi, size))
        # one interval for each character of each interval: firsts and lasts pair off in the order of the mapping
        new_lo, new_hi = np.sort(lf[at[first]]), np.sort(lf[at[last]]) + 1
        fresh = ~border[new_hi]
        lo, hi = new_lo[fresh].astype(np.int64), new_hi[fresh].astype(np.int64)
        border[hi] = True
    return border[:n]


def repeated_starts(parts: list[bytes], least: int) -> list[np.ndarray]:
    """Of every part, the places at which a string of `least` bytes starts that also starts elsewhere in the parts."""
    joined = bytes([SEPARATOR]).join(parts) + bytes([SEPARATOR])
    text = np.frombuffer(joined, np.uint8)
    order = suffix_order(text, least)
    border = common_prefix_borders(text, order, least)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    of = np.searchsorted(ends, order)
    valid = (order + least <= ends[np.minimum(of, len(ends) - 1)]) & (of < len(ends))
    group = np.cumsum(border) - 1
    size = np.bincount(group[valid], minlength=int(group[-1]) + 1)
    hit = np.sort(order[valid & (size[group] > 1)])
    starts = ends - np.array([len(p) for p in parts])
    cut = np.searchsorted(hit, ends)
    return [hit[a:b] - s for a, b, s in zip(np.append(0, cut[:-1]), cut, starts, strict=True)]


def spans_of(starts: np.ndarray) -> list[dict]:
    """Runs of consecutive places as first and last."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]


class Scanner:
    def __init__(self, least: int, anchor: int):
        self.least, self.anchor = least, anchor
        self.a, self.b = Rolling(211), Rolling(223)

    def __call__(self, data: np.ndarray, offs: np.ndarray):
        """Anchors: hash, first and last window start; and prefixes of the byte hashes."""
        p = self.a.prefix(data)
        keys = self.a.all_of(p, self.anchor)
        place, lo, hi = anchors(keys, self.least - self.anchor + 1, offs[:-1], np.maximum(offs[1:] - self.anchor + 1, offs[:-1]))
        return keys[place], lo, hi, p, place


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), text.cast("binary").alias("text"))


def facts(texts: DataFrame, least: int, anchor: int) -> DataFrame:
    """Of every distinct (doc_id, text): digest, number of bytes, hashes of its anchors."""

    def run(batches):
        scan = Scanner(least, anchor)
        for batch in batches:
            ids, digests = column(batch, "doc_id"), column(batch, "digest")
            for lo, hi, data, offs in chunks(column(batch, "text")):
                h, first, *_ = scan(data, offs)
                doc = np.searchsorted(offs, first, "right") - 1
                ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([ids[lo:hi], digests[lo:hi], pa.array(np.diff(offs)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))], ["doc_id", "digest", "n_bytes", "anchors"])

    return texts.mapInArrow(run, "doc_id long, digest string, n_bytes long, anchors array<long>").dropDuplicates(["doc_id", "digest"])


def stretches(texts: DataFrame, least: int, anchor: int) -> DataFrame:
    """texts(doc_id, digest, text, wanted): of each wanted anchor the bytes of its windows, their digest and place."""

    def run(batches):
        scan = Scanner(least, anchor)
        for batch in batches:
            ids, digests, wanted = column(batch, "doc_id"), column(batch, "digest"), column(batch, "wanted")
            for lo, _, data, offs in chunks(column(batch, "text")):
                h, first, last, p, place = scan(data, offs)
                if not len(h):
                    continue
                doc = np.searchsorted(offs, first, "right") - 1
                keep = np.zeros(len(h), bool)
                cut = np.searchsorted(doc, np.arange(len(offs)))
                lists = wanted[lo : lo + len(offs) - 1].to_pylist()
                for i, want in enumerate(lists):
                    keep[cut[i] : cut[i + 1]] = np.isin(h[cut[i] : cut[i + 1]], np.array(want, np.int64).view(np.uint64))
                h, first, last, doc, place = h[keep], first[keep], last[keep], doc[keep], place[keep]
                if not len(h):
                    continue
                second = scan.b.prefix(data)
                end = last + least
                g1, g2 = scan.a.between(p, first, end), scan.b.between(second, first, end)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.to_numpy()[lo + doc]), digests.take(pa.array(lo + doc)), pa.array(h.view(np.int64)), pa.array((first - offs[doc]).astype(np.int64)), pa.array(g1.view(np.int64)), pa.array(g2.view(np.int64)), pa.array(place - first), pa.array([raw[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)], pa.binary())],
                    ["doc_id", "digest", "h", "at", "g1", "g2", "lead", "part"],
                )

    return texts.mapInArrow(run, "doc_id long, digest string, h long, at long, g1 long, g2 long, lead long, part binary")


FOUND = "g1 long, g2 long, found array<struct<a: long, b: long>>"


def classes(lead: int, last: int, step: int) -> Iterator[tuple[int, int, int, int]]:
    """The windows of a stretch by their place before the anchor: class, first byte of the core, first and last window.

    Windows of one class have the bytes from the start of the last that the class can have up to the end of the first
    in common, least - step + 1 of them. Equal windows are in one class, at one place in it."""
    for c in range((lead - last) // step, lead // step + 1):
        start = lead - c * step
        yield c, start, max(0, start - step + 1), min(last, start)


def plausible(rows: list[tuple], least: int) -> list[tuple]:
    """Of one bucket (g1, g2, lead, part) the rows that have a core in common with another one. Equal cores have equal hashes."""
    step = min(STEP, least // 2)
    cores = [[hash((c, part[start : start - step + 1 + least])) for c, start, _, _ in classes(lead, len(part) - least, step)] for _, _, lead, part in rows]
    n = Counter(chain.from_iterable(cores))
    return [r for r, own in zip(rows, cores, strict=True) if any(n[x] > 1 for x in own)]


def by_transform(distinct: DataFrame, least: int) -> DataFrame:
    """distinct(h, g1, g2, lead, part): the runs of repeated windows in each part, whole buckets h by bucket in blocks."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        found = [spans_of(s) for s in repeated_starts([r[3] for r in rows], least)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(found, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["g1", "g2", "found"])

    def run(batches):
        block, size, bucket, last = [], 0, [], None
        for batch in batches:
            for h, *row in zip(*(column(batch, c).to_pylist() for c in ("h", "g1", "g2", "lead", "part")), strict=True):
                if h != last:
                    kept = plausible(bucket, least)
                    block += kept
                    size += sum(len(r[3]) for r in kept)
                    bucket, last = [], h
                    if size >= BLOCK:
                        yield solved(block)
                        block, size = [], 0
                bucket.append(tuple(row))
        block += plausible(bucket, least)
        if block:
            yield solved(block)

    return distinct.select("h", "g1", "g2", "lead", "part").repartition("h").sortWithinPartitions("h").mapInArrow(run, FOUND)


def by_window(distinct: DataFrame, least: int) -> DataFrame:
    """The same for buckets of any size: their single windows are grouped by 128 bits."""

    def run(batches):
        a, b = Rolling(211), Rolling(223)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for lo, _, data, offs in chunks(column(part, "part")):
                    n = np.diff(offs) - least + 1
                    start = np.repeat(offs[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    own = lambda c: pa.array(np.repeat(column(part, c).to_numpy()[lo : lo + len(n)], n))  # noqa: E731, B023
                    w1, w2 = (r.between(r.prefix(data), start, start + least) for r in (a, b))
                    yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), own("g1"), own("g2"), pa.array(start - np.repeat(offs[:-1], n))], ["w1", "w2", "g1", "g2", "k"])

    windows = distinct.select("g1", "g2", "part").mapInArrow(run, "w1 long, w2 long, g1 long, g2 long, k long")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    return windows.join(twice, ["w1", "w2"], "left_semi").groupBy("g1", "g2").agg(F.transform(F.collect_list("k"), lambda k: F.struct(k.alias("a"), k.alias("b"))).alias("found"))


PIECES = "g1 long, g2 long, c int, k long, n long, lead long, q1 long, q2 long, p1 long, p2 long, part binary"


def _two(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def by_core(distinct: DataFrame, least: int) -> DataFrame:
    """The same for large buckets: pieces of neighbouring windows, dealt out by the bytes that all of them hold.

    Equal windows stand at one place before their anchor, so they are in pieces of one class with one core."""
    step = min(STEP, least // 2)

    def run(batches):
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 7, pa.binary()]
        for batch in batches:
            rows = []
            for g1, g2, lead, part in zip(*(column(batch, c).to_pylist() for c in ("g1", "g2", "lead", "part")), strict=True):
                last = len(part) - least
                for c in range((lead - last) // step, lead // step + 1):
                    start = lead - c * step  # of the last window that this class can have
                    lo, hi = max(0, start - step + 1), min(last, start)
                    piece = part[lo : hi + least]
                    rows.append((g1, g2, c, lo, hi - lo + 1, lead - lo, *_two(part[start : start - step + 1 + least]), *_two(piece), piece))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    pieces = written(distinct.select("g1", "g2", "lead", "part").mapInArrow(run, PIECES), "pieces")
    core = ["c", "q1", "q2"]
    one = written(pieces.groupBy(*core, "p1", "p2").agg((F.count("*") > 1).alias("whole"), F.first("lead").alias("lead"), F.first("part").alias("part")), "cores")
    several = one.groupBy(*core).agg(F.count("*").alias("n")).where("n > 1")
    left = one.join(several, core).select(F.xxhash64(*core).alias("h"), F.col("p1").alias("g1"), F.col("p2").alias("g2"), "lead", "part", "n")
    found = by_transform(left.where(F.col("n") <= HOT), least).union(by_window(left.where(F.col("n") > HOT), least))
    verdict = one.select("p1", "p2", "whole").join(found.select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), "found"), ["p1", "p2"], "left")
    spans = F.when(F.col("whole"), F.array(F.struct(F.col("k").alias("a"), (F.col("k") + F.col("n") - 1).alias("b")))).otherwise(F.transform("found", lambda x: F.struct((F.col("k") + x["a"]).alias("a"), (F.col("k") + x["b"]).alias("b"))))
    back = pieces.select("g1", "g2", "k", "n", "p1", "p2").join(verdict, ["p1", "p2"])
    return back.select("g1", "g2", F.explode(spans).alias("s")).groupBy("g1", "g2").agg(F.collect_list("s").alias("found"))


def removed(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """doc_id, digest, n_bytes, n_removed, n_spans, kept_sha256 of every distinct (doc_id, text); keep_text adds kept.

    A byte goes if a string of `least` bytes that covers it also starts at any other place, in this document or another;
    overlapping strings count, and strings are judged on the input. A null text has no bytes; texts shorter than `least`
    lose none. Rows with a null doc_id are left out; rows that are repeated as wholes are one document; equal texts under
    different ids are copies of each other, whichever id is less. An empty table gives no rows. Other columns are not
    read. kept (binary) is null where nothing is removed; bytes are cut without regard to characters. Very long texts are
    read whole, each as a run of its own: a task then holds some fifty bytes for each of its longest text's."""
    texts = keyed(docs)
    own = written(facts(texts, least, anchor), "facts")
    copies = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    heads = own.join(copies.select("digest", F.col("first").alias("doc_id")), ["doc_id", "digest"], "left_semi")
    rows = heads.select("doc_id", "digest", F.explode("anchors").alias("h"))
    wanted = written(of_several(rows, "h").groupBy("doc_id", "digest").agg(F.collect_set("h").alias("wanted")), "wanted")
    marked = written(stretches(texts.join(wanted, ["doc_id", "digest"]), least, anchor), "stretches")
    # a row that is repeated as a whole is still one place, so places are told apart, not counted
    place = F.struct("doc_id", "digest", "at")
    distinct = written(marked.groupBy("h", "g1", "g2").agg((F.min(place) != F.max(place)).alias("whole"), F.first("part").alias("part"), F.first("lead").alias("lead")), "distinct")
    different = distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    cold = distinct.join(different.where(F.col("n") <= HOT).select("h"), "h", "left_semi")
    hot = distinct.join(different.where(F.col("n") > HOT).select("h"), "h", "left_semi")
    found = by_transform(cold, least).union(by_core(hot, least))
    rule = distinct.select("h", "g1", "g2", "whole").join(found, ["g1", "g2"], "left")
    hits = marked.select("doc_id", "digest", "h", "g1", "g2", "at", (F.length("part") - least).cast("long").alias("last")).join(rule, ["h", "g1", "g2"])
    spans = F.when(F.col("whole"), F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("last")).alias("b")))).otherwise(F.transform("found", lambda x: F.struct((F.col("at") + x["a"]).alias("a"), (F.col("at") + x["b"]).alias("b"))))
    cuts = hits.select("doc_id", "digest", F.explode(spans).alias("s")).groupBy("doc_id", "digest").agg(F.collect_list("s").alias("spans"))
    cut = written(_cut(texts.join(cuts, ["doc_id", "digest"]), least, keep_text), "cut").dropDuplicates(["doc_id", "digest"])
    all_of_it = (F.col("copies") > 1) & (F.col("n_bytes") >= least)
    return own.join(copies, "digest").join(cut, ["doc_id", "digest"], "left").select(
        "doc_id", "digest", "n_bytes",
        F.when(all_of_it, F.col("n_bytes")).otherwise(F.coalesce("cut_bytes", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_of_it, F.lit(1)).otherwise(F.coalesce("cut_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_of_it, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "digest")).alias("kept_sha256"),
        *([F.when(all_of_it, F.lit(b"")).otherwise(F.col("cut_kept")).alias("kept")] if keep_text else []),
    )


def _cut(texts: DataFrame, least: int, keep_text: bool) -> DataFrame:
    """texts(doc_id, digest, text, spans of string starts): what is left of the bytes."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for text, spans in zip(column(batch, "text").to_pylist(), column(batch, "spans").to_pylist(), strict=True):
            runs: list[list[int]] = []
            for a, b in sorted((s["a"], s["b"] + least) for s in spans):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            at, kept = 0, []
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            left = b"".join([*kept, text[at:]])
            yield len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left if keep_text else None

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, k, sha, left = zip(*rows(part), strict=True)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "digest"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha), pa.array(left, pa.binary())], ["doc_id", "digest", "cut_bytes", "cut_spans", "cut_sha256", "cut_kept"])

    return texts.select("doc_id", "digest", "text", "spans").mapInArrow(run, "doc_id long, digest string, cut_bytes long, cut_spans long, cut_sha256 string, cut_kept binary")
