"""What the operators share: a written cut of the lineage and whole-batch views of texts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where the session names none and runs on one machine, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='vellumite-')}"  # one machine, one disk
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: a later lost executor costs no more than a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: A key of more than this share of all rows whose keys are shared is hot. There are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 512


def of_several(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key another row has too.

    Rows of a hot key need no partner to be kept, so they are dealt out by themselves, not sent to one task."""
    counts = written(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > F.lit(total * HOT_SHARE)
    # fewer than 1 / HOT_SHARE keys: a proven bound for the broadcast
    flagged = rows.join(F.broadcast(counts.where(is_hot).select(key, F.lit(True).alias("_hot"))), key, "left")
    flagged = flagged.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), F.lit(1 << 20)) + 1).otherwise(F.lit(0)))
    cold = counts.where(~is_hot).select(key, F.lit(0).cast("long").alias("_salt"), F.lit(True).alias("_shared"))
    return flagged.join(cold, [key, "_salt"], "left").where("_hot or _shared").drop("_hot", "_salt", "_shared")


@contextmanager
def scratch() -> Iterator[None]:
    """What is written inside is deleted at the end: results must have been stored by then."""
    mark = len(_written)
    yield
    while len(_written) > mark:
        delete_path(*_written.pop())


@atexit.register
def _forget() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def chunks(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, last row + 1, their UTF-8 bytes, the offsets of each row in these.

    A null counts as an empty text. A longer text is a run of its own."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n, (_, offs, data) = len(texts), texts.buffers()
    if not n:
        return
    offs = np.frombuffer(offs, np.int64 if large else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words [^\\x20\\x09-\\x0D]+ in a run of texts, and the number of words before each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offs[(offs > 0) & (offs < len(data))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs)


class Rolling:
    """Hashes of any ranges of a sequence of integers by prefix sums modulo 2**64: equal ranges have equal hashes."""

    def __init__(self, seed: int):
        self.base = np.uint64((seed * 0x9E3779B97F4A7C15 | 5) & (2**64 - 1))
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            steps = np.full(n, self.base)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = self.inverse
            self.down = np.multiply.accumulate(steps)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * self.up[: len(values)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def all_of(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Of every range of k values."""
        n = len(prefix) - k
        return mixed((prefix[k:] - prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bits of a place within one pass over a run of keys; what is left of the 64 is compared.
PLACE_BITS = 22


def least_places(keys: np.ndarray, w: int) -> np.ndarray:
    """Of every w consecutive keys the place of the least by its upper 64 - PLACE_BITS bits, the leftmost of equal ones.

    What is compared does not depend on the length of the run, and long runs go in passes of 2**PLACE_BITS keys."""
    n, bits = len(keys) - w + 1, np.uint64(PLACE_BITS)
    out = np.empty(n, np.int64)
    most = (1 << PLACE_BITS) - w + 1
    if most < 1:
        raise ValueError("the window is longer than a pass")
    for a in range(0, n, most):
        part = keys[a : a + most + w - 1]
        least = (part >> bits << bits) | np.arange(len(part), dtype=np.uint64)
        step = 1
        while step * 2 <= w:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if w > step:
            least = np.minimum(least[: len(least) - (w - step)], least[w - step :])
        out[a : a + most] = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + a
    return out


def anchors(keys: np.ndarray, w: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers: of every w consecutive keys that lie in one text, the place of the least (the leftmost of equal ones).

    first, last: of each text, its first key and its last key + 1. Returns the places, in order, and of each the first
    and last window start that it stands for. Equal windows choose the same place, whatever else is in the run, so a
    repeated window has a repeated anchor; and each window has just one."""
    none = np.zeros(0, np.int64)
    if len(keys) < w:
        return none, none, none
    at = least_places(keys, w)
    mark = np.zeros(len(at) + 1, np.int32)
    a, b = first, last - w + 1
    some = b > a
    a, b = a[some], b[some]
    np.add.at(mark, a, 1)
    np.add.at(mark, b, -1)
    start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    if not len(start):
        return none, none, none
    place = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(start)) - 1
    return place[lo], start[lo], start[hi]
