"""Operator 9: substring dedup of 50-word windows behind a count-min prefilter.

Counting every window exactly would shuffle a row a word. Instead each partition adds what it reads to a count-min
sketch, of which only cells that are not zero are kept, and the sketches are merged by adding. The item counted for a window
is its anchor: of the shingles of ANCHOR words in it, the one of least hash. Equal windows have equal anchors, so an
anchor's count is no less than that of any window it stands for, and a cell's count no less than that of any anchor in
it: the estimate is never too low. Windows with an estimate of one are unique and go no further.

In the second pass only the stretches of estimated repeated windows are grouped exactly. Most are equal as wholes and meet
as one digest; where stretches of one anchor differ, their single windows are grouped. A stretch that a document has many
times, as one that repeats a line does, is one row with all its places. What is then covered by a window of a smaller doc_id
is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.llm._shared import Rolling, anchors, chunks, column, mixed, of_several, words, written

WINDOW, ANCHOR = 50, 20
#: Rows of the sketch, and cells of each row for every anchor counted.
DEPTH, CELLS = 2, 8


class Scanner:
    """Hashes of words, shingles and windows of runs of texts, two of 64 bits for each word."""

    def __init__(self, window: int, anchor: int):
        self.window, self.anchor = window, anchor
        self.a, self.b, self.ra, self.rb = Rolling(101), Rolling(103), Rolling(107), Rolling(109)

    def __call__(self, data: np.ndarray, offs: np.ndarray, both: bool):
        """Words (starts, ends, before each text), anchors (hash, first and last window), prefixes of word hashes."""
        s, e, before = words(data, offs)
        wa = self.a.between(self.a.prefix(data), s, e)
        pa_ = self.ra.prefix(wa)
        pb = self.rb.prefix(self.b.between(self.b.prefix(data), s, e)) if both else None
        keys = self.ra.all_of(pa_, self.anchor)
        place, lo, hi = anchors(keys, self.window - self.anchor + 1, before[:-1], np.maximum(before[1:] - self.anchor + 1, before[:-1]))
        return s, e, before, keys[place], lo, hi, pa_, pb

    def hashes(self, pa_, pb, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each range of words."""
        return self.ra.between(pa_, lo, hi), self.rb.between(pb, lo, hi)


def cells(h, anchors_total: int):
    """The cell of an anchor in each row of the sketch, as one long a row."""
    wide = max(1024, anchors_total * CELLS)
    return [F.pmod(F.xxhash64(h, F.lit(row)), F.lit(wide)) for row in range(DEPTH)]


def repeated(rows: DataFrame, total: int) -> DataFrame:
    """rows(h and others): those whose estimate in the merged sketch is two or more."""
    for cell in cells(F.col("h"), total):
        # what an earlier row of the sketch has dropped was seen once: the others' cells still count all of theirs
        rows = written(of_several(rows.withColumn("cell", cell), "cell").drop("cell"), "sketched")
    return rows


def facts(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Of every distinct (doc_id, text): digest, number of words, digest of all its words joined, hashes of its anchors."""

    def run(batches):
        scan = Scanner(window, anchor)
        for batch in batches:
            texts, ids, digests = column(batch, "text"), column(batch, "doc_id"), column(batch, "digest")
            for lo, hi, data, offs in chunks(texts):
                s, e, before, h, first, _, _, _ = scan(data, offs, False)
                doc = np.searchsorted(before, first, "right") - 1
                ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                raw = data.tobytes()
                kept = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], digests[lo:hi], pa.array(np.diff(before)), pa.array(kept), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))],
                    ["doc_id", "digest", "n_words", "all_sha256", "anchors"],
                )

    return docs.mapInArrow(run, "doc_id long, digest string, n_words long, all_sha256 string, anchors array<long>").dropDuplicates(["doc_id", "digest"])


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), text.alias("text"))


def stretches(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """texts(doc_id, digest, text, wanted): of each wanted anchor the stretches of its windows: g1, g2 its digest, w its windows.

    w packs 128 bits for every window of the stretch, in order. Equal stretches of a document are one row; at has their places."""

    def run(batches):
        scan = Scanner(window, anchor)
        for batch in batches:
            ids, digests, wanted = column(batch, "doc_id"), column(batch, "digest"), column(batch, "wanted")
            for lo, _, data, offs in chunks(column(batch, "text")):
                s, e, before, h, first, last, pa_, pb = scan(data, offs, True)
                if not len(h):
                    continue
                doc = np.searchsorted(before, first, "right") - 1
                lists = wanted[lo : lo + len(offs) - 1]
                want_doc = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
                want = lists.flatten().to_numpy().view(np.uint64)
                tag = lambda x, d: mixed(x ^ mixed(d.astype(np.uint64)))
                keep = np.isin(tag(h, doc), tag(want, want_doc))
                h, first, last, doc = h[keep], first[keep], last[keep], doc[keep]
                if not len(h):
                    continue
                g1, g2 = scan.hashes(pa_, pb, first, last + window)
                order = np.lexsort((first, h, g2, g1, doc))
                h, g1, g2, first, last, doc = (x[order] for x in (h, g1, g2, first, last, doc))
                new = np.ones(len(h), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]) | (h[1:] != h[:-1])
                head = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(head, len(h)), pa.int32()), pa.array((first - before[doc]).astype(np.int64)))
                h, g1, g2, first, last, doc = (x[head] for x in (h, g1, g2, first, last, doc))
                n = last - first + 1
                every = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                w1, w2 = scan.hashes(pa_, pb, every, every + window)
                packed = np.stack([w1, w2], 1).tobytes()
                ends = np.concatenate([[0], np.cumsum(n)]) * 16
                blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.to_numpy()[lo + doc]), digests.take(pa.array(lo + doc)), pa.array(h.view(np.int64)), places, pa.array(g1.view(np.int64)), pa.array(g2.view(np.int64)), blobs],
                    ["doc_id", "digest", "h", "at", "g1", "g2", "w"],
                )

    return texts.mapInArrow(run, "doc_id long, digest string, h long, at array<long>, g1 long, g2 long, w binary")


def _exploded(stretch: DataFrame) -> DataFrame:
    """stretch(g1, g2, w, doc_id) to a row a window: w1, w2, g1, g2, k (its place in the stretch), doc_id."""

    def run(batches):
        for batch in batches:
            n = np.array([len(x) // 16 for x in column(batch, "w").to_pylist()], np.int64)
            both = np.frombuffer(b"".join(column(batch, "w").to_pylist()), np.int64).reshape(-1, 2)
            rep = lambda c: pa.array(np.repeat(column(batch, c).to_numpy(), n))  # noqa: E731, B023
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), rep("g1"), rep("g2"), pa.array(k), rep("doc_id")], ["w1", "w2", "g1", "g2", "k", "doc_id"])

    return stretch.select("g1", "g2", "w", "doc_id").mapInArrow(run, "w1 long, w2 long, g1 long, g2 long, k long, doc_id long")


def removed(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """doc_id, digest, n_words, n_removed, kept_sha256 of every distinct (doc_id, text) of docs; keep_text adds kept_text.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. A word goes if a window of `window` words that covers it also starts, word for
    word, in a document with a smaller doc_id; windows are judged on the input. A null text has no words, and texts below
    a window lose none. Rows with a null doc_id have no place in the order and are left out; rows that are repeated as
    wholes are one document; rows of one doc_id with other texts are documents that do not cover each other. An empty
    table gives no rows. Other columns are not read. kept_text is null where nothing is removed. Very long texts are read
    whole, each as a run of its own: a task then holds some fifty bytes for each of its longest text's."""
    texts = keyed(docs)
    own = written(facts(texts, window, anchor), "facts")
    # exact copies: all windows of a copy start in the first of its group
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first"))
    own_first = own.join(first, "digest")
    heads = own.join(first.withColumnRenamed("first", "doc_id"), ["doc_id", "digest"], "left_semi")
    # 64 bits for a document are enough here: documents of one key would only want each other's anchors too
    key = F.xxhash64("doc_id", "digest").alias("row")
    # an anchor that one document has several times, and no other, is no repeat for this operator
    rows = written(heads.select(key, F.explode(F.array_distinct("anchors")).alias("h")), "anchors")
    wanted = repeated(rows, rows.count()).groupBy("row").agg(F.collect_list("h").alias("wanted"))
    # the texts that can lose words: written, so that the others are moved once only
    held = written(texts.select("*", key).join(wanted, "row").drop("row"), "held")
    marked = written(stretches(held, window, anchor), "stretches")
    distinct = written(marked.groupBy("h", "g1", "g2").agg(F.min("doc_id").alias("doc_id"), F.first("w").alias("w")), "distinct")
    # an anchor of which all stretches are equal needs no more; where they differ, so may some windows
    several = distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    singles = written(_exploded(distinct.join(several, "h", "left_semi")), "windows")
    least = singles.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "least")
    per_stretch = singles.join(least, ["w1", "w2"]).groupBy("g1", "g2").agg(F.collect_list(F.struct("k", "least")).alias("found"))
    rule = distinct.select("h", "g1", "g2", F.col("doc_id").alias("least")).join(per_stretch, ["g1", "g2"], "left")
    hits = marked.select("doc_id", "digest", "h", "g1", "g2", "at", (F.length("w") / 16).cast("long").alias("n")).join(rule, ["h", "g1", "g2"])
    whole = F.when(F.col("least") < F.col("doc_id"), F.transform("at", lambda a: F.struct(a.alias("a"), (a + F.col("n") - 1).alias("b"))))
    under = F.filter("found", lambda x: x["least"] < F.col("doc_id"))
    part = F.flatten(F.transform("at", lambda a: F.transform(under, lambda x: F.struct((a + x["k"]).alias("a"), (a + x["k"]).alias("b")))))
    spans = hits.select("doc_id", "digest", F.coalesce(whole, part).alias("s")).where(F.size("s") > 0).groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("s")).alias("spans"))
    cut = written(_cut(held.join(spans, ["doc_id", "digest"]), window, keep_text), "cut").dropDuplicates(["doc_id", "digest"])
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window)
    empty = F.sha2(F.lit(""), 256)
    out = own_first.join(cut, ["doc_id", "digest"], "left").select(
        "doc_id", "digest", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, empty).otherwise(F.coalesce("cut_sha256", "all_sha256")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("cut_text")).alias("kept_text")] if keep_text else []),
    )
    return out


def _cut(texts: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """texts(doc_id, digest, text, spans of window starts): what is left of the words."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for text, spans in zip(column(batch, "text").to_pylist(), column(batch, "spans").to_pylist(), strict=True):
            w = text.encode().split()
            mark = np.zeros(len(w) + 1, np.int64)
            np.add.at(mark, [s["a"] for s in spans], 1)
            np.add.at(mark, [s["b"] + window for s in spans], -1)
            keep = np.cumsum(mark[:-1]) == 0
            kept = b" ".join([x for x, k in zip(w, keep.tolist(), strict=True) if k])
            yield len(w) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, sha, left = zip(*rows(part), strict=True)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "digest"), pa.array(n, pa.int64()), pa.array(sha), pa.array(left, pa.string())], ["doc_id", "digest", "cut_words", "cut_sha256", "cut_text"])

    return texts.select("doc_id", "digest", "text", "spans").mapInArrow(run, "doc_id long, digest string, cut_words long, cut_sha256 string, cut_text string")
