"""Structured Streaming over event logs: running counts, deduplication and a sliding-window limiter with keyed state."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.stats import clean_events, decide
from ..storage import new_path, ship


def event_stream(spark: SparkSession, path: str, schema, files: int = 10) -> DataFrame:
    """Parquet events as they arrive; ts becomes a timestamp, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


#: Fields of an event in a JSON log.
LOGGED = "event string, path string, target string, session string, ts string, ua string"


def ingest_log(spark: SparkSession, path: str, out: str, checkpoint: str, files: int = 100) -> None:
    """Takes a JSON-lines log in as it grows, all that is there now: page views and clicks go to out/events, lines that aren't JSON or name
    no such event, with the reason, to out/rejected, and each batch's hourly counts and its sessions by hour to out/hours and out/sessions. Every batch replaces what an
    earlier try of the same batch wrote, so one that is run again changes nothing."""

    def take(batch: DataFrame, number: int) -> None:
        read = batch.select("value", F.from_json("value", f"{LOGGED}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
        reason = F.when(F.col("e").isNull() | F.col("e._bad").isNotNull(), "not JSON").when(~F.coalesce(F.col("e.event").isin("pageview", "click"), F.lit(False)), "unknown event")
        read = read.withColumn("reason", reason).persist()
        good = clean_events(read.filter("reason is null").select("e.*").drop("_bad"))
        timed = good.withColumn("hour", F.date_trunc("hour", "ts"))
        hours = timed.groupBy("hour", "event").agg(F.count("*").alias("n"))
        sessions = timed.filter("event = 'pageview' and session <> ''").select("hour", "session").distinct()
        for name, df in (("events", good), ("rejected", read.filter("reason is not null").select("value", "reason")), ("hours", hours), ("sessions", sessions)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        read.unpersist()

    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path).filter("trim(value) <> ''")
    lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def hourly_totals(spark: SparkSession, out: str) -> DataFrame:
    """(hour, pageviews, clicks, sessions) of all batches that ingest_log() has taken: counts add up, and sessions that view a page are counted
    exactly over batches."""
    counts = spark.read.parquet(f"{out}/hours").groupBy("hour").agg(*[F.sum(F.when(F.col("event") == e, F.col("n")).otherwise(0)).alias(f"{e}s") for e in ("pageview", "click")])
    seen = spark.read.parquet(f"{out}/sessions").groupBy(F.col("hour").alias("_hour")).agg(F.countDistinct("session").alias("sessions"))
    return counts.join(seen, F.col("hour").eqNullSafe(F.col("_hour")), "left").select("hour", "pageviews", "clicks", F.coalesce("sessions", F.lit(0)).alias("sessions"))


def window_counts(events: DataFrame, late: str = "1 day", size: str = "1 hour") -> DataFrame:
    """Events by type and window; a window is final when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key; keys are forgotten after the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class Limiter(StatefulProcessor):
    """Keeps the times of one key's allowed hits, limit of them at most. Denied hits aren't kept. A batch's hits of the key are put into order
    together, in however many pieces they come."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = deque(x[0] for x in self.kept.get())
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])
        out = [decide(times, t, self.limit, self.window) for t in frame["at"]]
        yield pd.DataFrame({"key": key[0], "event_id": frame["event_id"], "at": frame["at"], "allowed": [a for a, _ in out], "retry_after": [w for _, w in out]})
        self.kept.put([(t,) for t in times]) if times else self.kept.clear()

    def close(self) -> None:
        pass


AT_ONCE = 100_000  # hits of a key that are in memory before they wait
SLICES = 60  # of a window: hits wait in slices, so that a task holds one slice of a key's hits


class EventTimeLimiter(StatefulProcessor):
    """Decides one key's hits in the order of their own times, whatever the order of their coming: each waits in its slice of time until
    the watermark has passed the slice. Each rule has a limit and a window of its own; hits of other rules are allowed. When the watermark has passed
    the last allowed hit by a window, nothing of the key is left."""

    def __init__(self, limits: dict[str, tuple[int, float]]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long", "at array<double>, event_id array<long>")
        self.kept = handle.getValueState("kept", "times array<double>")

    def _size(self, key) -> tuple[int, float, float]:
        limit, window = self.limits.get(key[0], (2**62, 3600.0))
        return limit, window, window / SLICES

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, _, size = self._size(key)
        pieces, n = [], 0
        for frame in rows:  # pieces can be small, and each write of a slice costs a call
            pieces.append(frame)
            n += len(frame)
            if n >= AT_ONCE:
                self._wait(pd.concat(pieces), size)
                pieces, n = [], 0
        if pieces:
            self._wait(pd.concat(pieces), size)
        return iter(())

    def _wait(self, frame: pd.DataFrame, size: float) -> None:
        for slice_, own in frame.groupby((frame["at"] // size).astype("int64")):
            k = (int(slice_),)
            at, ids = self.waiting.getValue(k) if self.waiting.containsKey(k) else ([], [])
            self.waiting.updateValue(k, ([*at, *own["at"].tolist()], [*ids, *own["event_id"].tolist()]))
            self.handle.registerTimer(self._end(k[0], size))

    @staticmethod
    def _end(slice_: int, size: float) -> int:
        """The first millisecond after a slice."""
        return int((slice_ + 1) * size * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit, window, size = self._size(key)
        due = expiredTimerInfo.getExpiryTimeInMs()
        times = deque(self.kept.get()[0]) if self.kept.exists() else deque()
        for (slice_,) in sorted(k for k in self.waiting.keys() if self._end(k[0], size) <= due):
            frame = pd.DataFrame(dict(zip(("at", "event_id"), self.waiting.getValue((slice_,)), strict=True))).sort_values(["at", "event_id"])
            self.waiting.removeKey((slice_,))
            out = [decide(times, t, limit, window) for t in frame["at"]]
            yield pd.DataFrame({"rule": key[0], "key": key[1], "event_id": frame["event_id"], "at": frame["at"], "allowed": [a for a, _ in out], "retry_after": [w for _, w in out]})
        while times and times[0] <= due / 1000 - window:
            times.popleft()
        if times and key[0] in self.limits:
            self.kept.update((list(times),))
            self.handle.registerTimer(int((times[-1] + window) * 1000) + 1)
        else:
            self.kept.clear()

    def close(self) -> None:
        pass


def _with_state(spark: SparkSession) -> None:
    """For processors: the state store that they need, and pickling by value, since the driver's own Python worker, which asks a processor for
    its states, has no packages that were shipped to executors."""
    ship(spark)
    for module in (__name__, decide.__module__):
        cloudpickle.register_pickle_by_value(sys.modules[module])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def limited(hits: DataFrame, limit: int, window: float) -> DataFrame:
    """hits(key, event_id, at in seconds) with allowed and retry_after, with state from batch to batch: hits of a batch are in order, and
    batches in the order of their coming. It needs the RocksDB state store."""
    _with_state(hits.sparkSession)
    schema = "key long, event_id long, at double, allowed boolean, retry_after long"
    return hits.groupBy("key").transformWithStateInPandas(Limiter(limit, window), schema, "Append", "None")


def limited_by_event_time(hits: DataFrame, limits: dict[str, tuple[int, float]], late: str = "10 minutes") -> DataFrame:
    """hits(rule, key, event_id, at in seconds) with allowed and retry_after, as if they came in the order of (at, event_id). limits: (limit,
    window in seconds) by rule. A hit is decided when the watermark, the latest time less late, has passed it; one that comes after
    that is dropped. It needs the RocksDB state store."""
    _with_state(hits.sparkSession)
    timed = hits.select("rule", "key", "event_id", "at", F.timestamp_seconds("at").alias("ts")).withWatermark("ts", late)
    schema = "rule string, key long, event_id long, at double, allowed boolean, retry_after long"
    return timed.groupBy("rule", "key").transformWithStateInPandas(EventTimeLimiter(limits), schema, "Append", "EventTime")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, f"{name}-out"), new_path(spark, f"{name}-state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = stream.writeStream.foreachBatch(replace).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
