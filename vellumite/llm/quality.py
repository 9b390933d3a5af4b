"""Operator 2: quality classifier by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed character trigrams, weighted by log frequency and inverse document frequency, next to a
few shares of character classes and repeats. A truncated singular value decomposition of a bounded labelled sample gives
the latent space. The sample's vectors and labels are broadcast; the exact cosine of every document with every labelled
vector is computed block by block as a matrix product, and the labels of the nearest are weighted by their similarity.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.llm._shared import Rolling, chunks, column, words

#: Labelled rows that are learnt from at most: those of each label with the least hash of their id.
SAMPLE = 4000
#: Hashed terms; dimensions of the latent space; neighbours that vote.
TERMS, RANK, NEIGHBOURS = 1 << 11, 48, 25
THRESHOLD = 0.3

#: Character classes whose shares are features.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "marks": b"#$%&*@^~|<>{}[]=+_\\/", "ends": b"!?", "stops": b".,;:'\"()-", "lines": b"\n\r"}
_TABLE = np.zeros((len(_CLASSES), 256), np.float32)
for _i, _c in enumerate(_CLASSES.values()):
    _TABLE[_i, list(_c)] = 1
N_SHAPE = len(_CLASSES) + 6


class Features:
    """Of a run of texts: sparse term counts (row, term, count) and dense shape features."""

    def __init__(self):
        self.word, self.gram = Rolling(17), Rolling(19)

    def __call__(self, data: np.ndarray, offs: np.ndarray):
        n = len(offs) - 1
        size = np.diff(offs)
        some = np.maximum(size, 1)
        shape = np.zeros((n, N_SHAPE), np.float32)
        full = np.flatnonzero(size)
        at = offs[:-1][full]
        if len(data):
            for i in range(len(_CLASSES)):
                shape[full, i] = np.add.reduceat(_TABLE[i][data], at)
            shape[:, : len(_CLASSES)] /= some[:, None]
            shape[full, -1] = np.add.reduceat((data >= 128).astype(np.float32), at) / some[full]
        s, e, before = words(data, offs)
        count = np.diff(before)
        of = np.repeat(np.arange(n), count)
        one = np.maximum(count, 1)
        long = np.bincount(of, weights=(e - s), minlength=n) if len(s) else np.zeros(n)
        shape[:, -2] = np.minimum(long / one / 16, 2)
        shape[:, -3] = np.log1p(count) / 10
        rows = cols = np.zeros(0, np.int64)
        if len(s):
            h = self.word.between(self.word.prefix(data), s, e)
            key = np.sort((h & np.uint64((1 << 40) - 1)) | (of.astype(np.uint64) << np.uint64(40)))
            new = np.append(True, key[1:] != key[:-1])
            distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)
            shape[:, -4] = distinct / one
            heads = np.bincount(of, weights=np.isin(data[s], np.frombuffer(_CLASSES["marks"], np.uint8)), minlength=n)
            shape[:, -5] = heads / one
            tails = np.bincount(of, weights=np.isin(data[e - 1], np.frombuffer(_CLASSES["marks"] + _CLASSES["ends"], np.uint8)), minlength=n)
            shape[:, -6] = tails / one
        grams = self.gram.all_of(self.gram.prefix(data), 3)
        if len(grams):
            row = np.repeat(np.arange(n), size)[: len(grams)]
            inside = np.arange(len(grams)) + 3 <= offs[row + 1]
            rows, cols = row[inside], (grams[inside] >> np.uint64(64 - 11)).astype(np.int64)
        flat = np.bincount(rows * TERMS + cols, minlength=n * TERMS).reshape(n, TERMS) if n else np.zeros((0, TERMS))
        return np.log1p(flat).astype(np.float32), shape


class Latent:
    """The fitted space: weights of terms, mean, axes, and the labelled vectors in it."""

    def __init__(self, terms: np.ndarray, shape: np.ndarray, label: np.ndarray):
        n = len(label)
        self.idf = np.log((1 + n) / (1 + (terms > 0).sum(0))).astype(np.float32) + 1
        self.mid, self.spread = shape.mean(0), shape.std(0) + 1e-3
        x = self._joined(terms, shape)
        self.mean = x.mean(0)
        rank = max(1, min(RANK, min(x.shape)))
        x -= self.mean
        _, vectors = np.linalg.eigh(x.T @ x)
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)
        self.vectors, self.labels = self._unit(x @ self.axes), label.astype(np.float32)

    def _joined(self, terms, shape):
        t = terms * self.idf
        t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-6)
        return np.hstack([t, np.clip((shape - self.mid) / self.spread, -6, 6) * np.float32(0.15)]).astype(np.float32, copy=False)

    @staticmethod
    def _unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, terms, shape) -> np.ndarray:
        """Of every row the share of similarity that its nearest neighbours of label 1 have."""
        own = self._unit((self._joined(terms, shape) - self.mean) @ self.axes)
        cosine = own @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** 4
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Latent | None:
    """Learn from at most `sample` labelled rows that are not held out; None if there are none.

    An executor learns, in one task that gets the sparse counts of these rows; the driver gets the fitted space alone.

    Rows of both labels are taken in equal number as far as there are any (labels of 0 are few), those with the least
    hash of their id; repeated or contradictory labels of an id count as one, the least."""
    wanted = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = None
    for value in (0, 1):
        part = wanted.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        ids = part if ids is None else ids.union(part)
    # at most `sample` ids: a proven bound for the broadcast
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    # of rows that share an id one is learnt from, that of the least text
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality").mapInArrow(_sparse, "doc_id long, quality int, terms binary, counts binary, shape binary")
    found = rows.repartition(1).mapInArrow(_fitted, "model binary").collect()  # one row, or none
    return pickle.loads(found[0].model) if found else None


def _fitted(batches):
    """The pickled Latent of all rows of _sparse, in the order of their ids."""
    found = sorted(row for batch in batches for row in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "quality", "terms", "counts", "shape")), strict=True))
    if not found:
        return
    terms = np.zeros((len(found), TERMS), np.float32)
    for i, (_, _, at, counts, _) in enumerate(found):
        terms[i, np.frombuffer(at, np.uint16)] = np.frombuffer(counts, np.float32)
    model = Latent(terms, np.array([np.frombuffer(r[4], np.float32) for r in found]), np.array([r[1] for r in found]))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def _sparse(batches):
    make = Features()
    for batch in batches:
        ids, quality = column(batch, "doc_id"), column(batch, "quality")
        for lo, hi, data, offs in chunks(column(batch, "text"), 1 << 20):
            terms, shape = make(data, offs)
            at = [np.flatnonzero(t).astype(np.uint16) for t in terms]
            yield pa.RecordBatch.from_arrays(
                [ids[lo:hi].cast(pa.int64()), quality[lo:hi].cast(pa.int32()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([t[a].tobytes() for t, a in zip(terms, at, strict=True)], pa.binary()), pa.array([x.tobytes() for x in shape], pa.binary())],
                ["doc_id", "quality", "terms", "counts", "shape"],
            )


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (and the columns named in carry), without a shuffle.

    The score is from 0 to 1, higher for label 1, from the whole text alone: labels, lang, source and doc_id are no
    inputs. A null text counts as empty; empty texts are scored like others. A null doc_id is not held out. Repeated rows
    and ties get equal scores. Without any labelled row every score is 0.5. Other columns are not read. Very long texts are
    read whole, each as a run of its own. carry names columns of docs to keep, none of the four of the result."""
    if clash := {"doc_id", "held_out", "score", "predicted"} & set(carry):
        raise ValueError(f"columns of the result cannot be carried: {sorted(clash)}")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    texts = docs.select("doc_id", *carry, F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text") if "text" not in carry else F.lit(None).cast("string").alias("unused"))
    texts = texts.drop("unused")
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in texts.select(*carry).schema)

    def run(batches):
        make = Features()
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if model.value is not None:
                for lo, hi, data, offs in chunks(column(batch, "text"), 1 << 20):
                    for a in range(0, hi - lo, 1024):
                        cut = offs[a : min(hi - lo, a + 1024) + 1]
                        score[lo + a : lo + a + len(cut) - 1] = model.value.score(*make(data[cut[0] : cut[-1]], cut - cut[0]))
            score = np.clip(score, 0, 1)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").cast(pa.int64()), column(batch, "held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), *(column(batch, c) for c in carry)],
                ["doc_id", "held_out", "score", "predicted", *carry],
            )

    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + extra)
