"""Operator 4: benchmark decontamination by size-partitioned MinHash containment search.

Test items are parted by the number of their word shingles (sizes doubling from part to part). Of an item with n
shingles the signature is its bottom-k MinHash sketch: the k shingles of least hash. A document that holds the share t
of the item lacks at most n - ceil(t n) of its shingles, so k = n' - ceil(t n') + 1, n' the largest size in the item's
part, makes sure that at least one signature shingle is in the document: the candidate search loses nothing. Every
candidate is then verified by counting, exactly, the item's shingles (as text) in the document. An item of fewer words
than a shingle has is one shingle of its own length, and documents are searched by shingles of that length too.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.llm._shared import Rolling, chunks, column, words, written

#: Bytes of benchmark text that are broadcast at once; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 16 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(text: str | None, k: int = 5) -> set[bytes]:
    """Distinct shingles of k words (A-Z in lower case; fewer words: the whole sequence; none: no shingle)."""
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


class Ensemble:
    """Signatures of a block of items, by size partition, as one sorted table of hashes."""

    def __init__(self, items: list[tuple[int, str]], k: int, share: float):
        self.k, self.share = k, share
        self.word_hash, self.run_hash = Rolling(11), Rolling(13)
        self.items = [(i, s, min(k, next(iter(s)).count(b" ") + 1)) for i, s in ((i, shingles(t, k)) for i, t in items) if s]
        self.lengths = sorted({n for *_, n in self.items})
        found: list[tuple[int, int]] = []
        parts = defaultdict(list)
        for place, (_, s, _) in enumerate(self.items):
            parts[len(s).bit_length()].append((place, s))
        for part, members in parts.items():
            largest = min(2**part - 1, max(len(s) for _, s in members))
            depth = largest - math.ceil(share * largest - 1e-9) + 1
            for place, s in members:
                found += [(h, place) for h in sorted({self.hash_text(x) for x in s})[:depth]]
        found.sort()
        self.hashes = np.array([h for h, _ in found], np.uint64)
        self.places = np.array([p for _, p in found], np.int64)
        self.bits = 16 + max(1, len(found)).bit_length()
        self.bits = min(self.bits, 26)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hash_text(self, shingle: bytes) -> int:
        data = np.frombuffer(shingle, np.uint8)
        n = shingle.count(b" ") + 1
        return int(next(self.hash_runs(data, np.array([0, len(data)]), [n]))[0][0])

    def hash_runs(self, data: np.ndarray, offs: np.ndarray, lengths: list[int]):
        """For each length, the hashes of the runs of so many words in each text, and the number of runs before each text."""
        data = LOWER[data]
        s, e, before = words(data, offs)
        if not len(s):
            return
        runs = self.run_hash.prefix(self.word_hash.between(self.word_hash.prefix(data), s, e))
        n = np.diff(before)
        for k in lengths:
            size = np.maximum(n - k + 1, 0)
            first = np.repeat(before[:-1], size) + _counts(size)
            yield self.run_hash.between(runs, first, first + k), np.concatenate([[0], np.cumsum(size)])

    def candidates(self, data: np.ndarray, offs: np.ndarray) -> dict[int, set[int]]:
        """Rows and the places of items whose signature they touch."""
        out: dict[int, set[int]] = defaultdict(set)
        for h, before in self.hash_runs(data, offs, self.lengths):
            hit = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(self.hashes, h[hit], "left"), np.searchsorted(self.hashes, h[hit], "right")
            some = np.flatnonzero(hi > lo)
            row = np.searchsorted(before, hit[some], "right") - 1
            for r, a, b in zip(row.tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                out[r].update(self.places[a:b].tolist())
        return out


def _counts(size: np.ndarray) -> np.ndarray:
    """0 .. n-1 for every n of size."""
    total = int(size.sum())
    start = np.cumsum(size) - size
    return np.arange(total) - np.repeat(start, size)


SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def contained(docs: DataFrame, items: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """Pairs of a document and an item of which it holds at least `share` of the distinct k-word shingles.

    docs: doc_id, text; items: item_id, text. Rows with a null id and items without words are left out; texts that are
    null or empty hold nothing. An item of fewer than k words is its whole sequence, and is found wherever a document has
    it. Very long texts are read whole, one at a time. Repeated rows give repeated pairs; ties don't arise; empty tables
    give no rows; other columns are not read. Documents are not shuffled; items are broadcast in blocks of BLOCK_BYTES of
    text at most, one search of the documents for each block, whose pairs are written before the next goes out."""
    spark = docs.sparkSession
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(2 * total / BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    out = None
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.toLocalIterator()])

        def run(batches, sent=sent):
            index = Ensemble(sent.value, k, share)
            for batch in batches:
                texts, ids, rows = column(batch, "text"), column(batch, "doc_id"), []
                for lo, _, data, offs in chunks(texts):
                    for r, places in index.candidates(data, offs).items():
                        have: dict[int, set[bytes]] = {}
                        for place in sorted(places):
                            item, wanted, length = index.items[place]
                            if length not in have:
                                have[length] = shingles(texts[lo + r].as_py(), length)
                            n = len(wanted & have[length])
                            if n >= share * len(wanted) - 1e-9:
                                rows.append((ids[lo + r].as_py(), item, len(wanted), n, n / len(wanted)))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.float64())], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

        found = docs.mapInArrow(run, SCHEMA)
        if blocks > 1:
            found = written(found, "found")
            sent.destroy()
        out = found if out is None else out.union(found)
    return out


def without_benchmark(docs: DataFrame, items: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """docs without the rows whose text holds an item. Rows are told by 64 bits of hash of their text, so that null and
    repeated doc_ids do no harm."""
    keyed = docs.withColumn("_text_key", F.xxhash64(F.col("text").cast("string")))
    found = contained(keyed.select(F.col("_text_key").alias("doc_id"), "text"), items, k, share).select(F.col("doc_id").alias("_text_key")).distinct()
    return keyed.join(found, "_text_key", "left_anti").select(*docs.columns)
