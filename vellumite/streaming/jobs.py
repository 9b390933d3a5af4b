"""Event streams: sessions, latest state, debounce, replay, late data. Each has a batch twin in operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Event files as a stream, in the order of their appearance."""
    raw = spark.readStream.schema(EVENTS.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def session_counts(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def latest_heartbeat(events: DataFrame) -> DataFrame:
    """The last event of each key so far (update mode)."""
    return events.groupBy("user_id").agg(F.max("ts").alias("heartbeat"), F.max_by("event_type", "ts").alias("stage"))


def without_replays(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, so that a replayed batch adds nothing."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


DEBOUNCED = "user_id long, event_id long, event_type string, micros long"


def debounced(events: DataFrame, every_seconds: int = 3600) -> DataFrame:
    """Events that change a key's stage, or come `every_seconds` after the last one sent. State: that last one."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent_at, sent_stage = state.get if state.exists else (None, None)
        rows = sorted(r for f in frames for r in zip(f.micros.tolist(), f.event_id.tolist(), f.event_type.tolist(), strict=True))
        out = []
        for at, event_id, stage in rows:
            if sent_at is None or stage != sent_stage or at - sent_at >= every_seconds * 1_000_000:
                sent_at, sent_stage = at, stage
                out.append((key[0], event_id, stage, at))
        state.update((sent_at, sent_stage))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type", "micros"])

    keyed = events.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("micros"))
    return keyed.groupBy("user_id").applyInPandasWithState(step, DEBOUNCED, "sent_at long, sent_stage string", "append", GroupStateTimeout.NoTimeout)


def current_state(events: DataFrame) -> DataFrame:
    """The event log folded to the state of each run: the request that is open, counts, the last stage."""
    started, done = F.col("event_type") == "signup", F.col("event_type").isin("purchase", "error")
    return events.groupBy("user_id").agg(F.count_if(started).alias("started"), F.count_if(done).alias("completed"), F.max(F.when(started, F.col("ts"))).alias("last_start"), F.max(F.when(done, F.col("ts"))).alias("last_end"), F.max_by("event_type", "ts").alias("stage"))


def overdue(heartbeats: DataFrame, now, seconds: int) -> DataFrame:
    """Keys whose last sign of life is older than the limit (a supervisor's tick)."""
    return heartbeats.where(F.col("heartbeat") < now - F.make_interval(secs=F.lit(seconds)))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into memory; for small results and tests."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
