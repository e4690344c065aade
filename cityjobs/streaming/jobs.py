"""Structured Streaming forms of the sensor and request jobs."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructField, StructType

from ..operators.chunks import CUT, chunk_documents
from ..operators.urls import keep_checkpoints
from ..sources.store import ChunkStore

DECIDED = "key string, ts timestamp, accepted boolean"
#: Requests that are decided and given out at a time.
AT_ONCE = 100_000


def sensor_windows(stream: DataFrame, key: str, ts: str, val: str, window: str = "1 hour", slide: str | None = None, watermark: str = "2 hours") -> DataFrame:
    """Count and mean by key and window; readings later than the watermark are dropped."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, watermark).groupBy(frame, key).agg(F.count("*").alias("n"), F.avg(val).alias("mean")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


class LatestReading(StatefulProcessor):
    """Keeps a key's latest reading, until event time is `ttl` past it."""

    def __init__(self, schema: StructType, ts: str, ttl: timedelta) -> None:
        self.schema, self.ts, self.ttl = schema, ts, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.latest = handle, handle.getValueState("latest", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        names, best = self.schema.names, None
        place = lambda row: (row[names.index(self.ts)], str(row))
        for batch in rows:  # one at a time: none is held
            some = batch[batch[self.ts].notna()]
            some = some[some[self.ts] == some[self.ts].max()]
            for row in some[names].astype(object).where(some[names].notna(), None).itertuples(index=False, name=None):
                row = tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row)
                best = row if best is None or place(row) > place(best) else best
        if best is None:
            return
        if self.latest.exists():
            old = tuple(self.latest.get())
            if place(old) >= place(best):  # what comes out of order does not win
                return
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        self.latest.update(best)
        at = pd.Timestamp(best[names.index(self.ts)]).tz_localize(None)
        self.handle.registerTimer(max(int(at.timestamp() * 1000) + int(self.ttl.total_seconds() * 1000), timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame([(*key, *best)], columns=None).set_axis(["_key", *names], axis=1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_latest(stream: DataFrame, key: str, ts: str, watermark: str = "1 day", ttl: timedelta = timedelta(days=7)) -> DataFrame:
    """The latest reading of each key, in update mode: a row whenever a key has a later one. Null times count for nothing.

    State: one reading a key, which goes when event time is `ttl` past it; a reading later than the watermark is
    dropped, so none that is older than what has gone can win. Of readings of the same time the greatest row counts.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rest = StructType([f for f in stream.schema.fields if f.name != key])
    out = StructType([StructField("_key", stream.schema[key].dataType), *rest.fields])
    found = stream.withWatermark(ts, watermark).groupBy(key).transformWithStateInPandas(LatestReading(rest, ts, ttl), out, "update", "eventTime")
    return found.withColumnRenamed("_key", key)


def decide(times: list[int], accepted: list[int], window_s: int, n: int) -> tuple[list[bool], list[int]]:
    """Sliding log over sorted microseconds: a request passes if fewer than n accepted ones are younger than the window."""
    out, log = [], list(accepted)
    for t in times:
        log = [x for x in log if t - x <= window_s * 1_000_000]
        out.append(len(log) < n)
        if out[-1]:
            log.append(t)
    return out, log


def stretches(rows: DataFrame, window_s: int) -> DataFrame:
    """Adds `stretch`: a number that changes where a key pauses for longer than the window.

    Requests are counted into slots as wide as the window, with the first and last time of each; only those meet in
    a task by key. A pause longer than the window always lies between two slots, so every one is found.
    """
    slot = F.floor(F.unix_micros("ts") / F.lit(window_s * 1_000_000)).alias("slot")
    slots = rows.groupBy("key", slot).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    in_time = W.partitionBy("key").orderBy("slot")
    pause = F.unix_micros("first") - F.unix_micros(F.lag("last").over(in_time)) > window_s * 1_000_000
    numbered = slots.withColumn("pause", F.coalesce(pause, F.lit(False)).cast("int")).withColumn("stretch", F.sum("pause").over(in_time)).select("key", "slot", "stretch")
    return rows.withColumn("slot", slot).join(numbered, ["key", "slot"]).drop("slot")


def rate_limit(df: DataFrame, key: str, ts: str, window_s: int = 3600, n: int = 5) -> DataFrame:
    """(key, ts, accepted) of every request; null keys and times are left out.

    No accepted request is remembered beyond the window, so what follows a longer pause depends on nothing before it:
    a key's stretches between such pauses are decided on their own, in different tasks. A stretch comes as a stream of
    batches in one task, of which only n accepted times are held; a key that never pauses is one stretch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, log = None, []
        for rows in batches:
            out = []
            for at, part in rows.groupby(["key", "stretch"], sort=False):
                if at != now:
                    now, log = at, []
                times = part["ts"].astype("int64") // (1000 if str(part["ts"].dtype).endswith("[ns]") else 1)
                found, log = decide(times.tolist(), log, window_s, n)
                out.append(part.assign(accepted=found))
            if out:
                yield pd.concat(out)[["key", "ts", "accepted"]]

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("key is not null and ts is not null")
    return stretches(rows, window_s).repartition("key", "stretch").sortWithinPartitions("key", "stretch", "ts").mapInPandas(run, DECIDED)


def stream_rate_limit(stream: DataFrame, key: str, ts: str, window_s: int = 3600, n: int = 5, watermark: str = "1 hour") -> DataFrame:
    """The same on a stream; requests later than the watermark are dropped. State: a key's accepted times, at most n,
    gone when the watermark has passed the last one's window. Timeouts follow event time, so that a run over what is
    there ends.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        # of a key's requests in a batch only their times are held, eight bytes each, as they must be put in order
        micros = lambda ts: (ts.astype("int64") // (1000 if str(ts.dtype).startswith("datetime64[ns") else 1)).to_numpy()
        times = np.sort(np.concatenate([micros(b["ts"]) for b in batches]))
        for lo in range(0, len(times), AT_ONCE):
            some = times[lo : lo + AT_ONCE]
            found, log = decide(some.tolist(), log, window_s, n)
            yield pd.DataFrame({"key": keys[0], "ts": pd.to_datetime(some, unit="us"), "accepted": found})
        log = log[-n:]
        state.update((log,))
        state.setTimeoutTimestamp(max(log[-1] // 1000 + window_s * 1000, state.getCurrentWatermarkMs()) + 1)

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("key is not null and ts is not null").withWatermark("ts", watermark)
    return rows.groupBy("key").applyInPandasWithState(run, DECIDED, "accepted array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_upsert(stream: DataFrame, store: ChunkStore, checkpoint: str, watermark: str = "1 day", first_batch: int = 0, longest: int | None = CUT) -> DataStreamWriter:
    """New document versions, chunked, replace whole documents of the store, of which a micro-batch rewrites only the
    buckets that its documents are in.

    A micro-batch is committed under its number, from first_batch on (above those that others wrote): one that fails half-way
    is written again, one that comes again after its commit changes nothing. Versions of a document that come again, or
    later than the watermark, are dropped. longest: as in chunk_documents.
    """

    def merge(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("source_url", "language").agg(F.max_by(F.struct("*"), "updated_at").alias("_r")).select("_r.*")
        keep_checkpoints(batch.sparkSession)
        store.upsert(chunk_documents(latest.withColumn("updated_at", F.col("updated_at").cast("date")), longest=longest).checkpoint(), first_batch + number)

    fresh = stream.withWatermark("updated_at", watermark).dropDuplicatesWithinWatermark(["source_url", "language", "updated_at"])
    return fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
