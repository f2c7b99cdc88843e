"""Statistics of event logs: filtered counts, distinct counts, ranked groups, deduplication, rate limiting."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import ship


def count_where(df: DataFrame, predicate: Column, name: str = "n") -> DataFrame:
    return df.agg(F.count_if(predicate).alias(name))


def distinct_where(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Exact number of different values; null and empty don't count."""
    return df.filter((F.col(column).isNotNull()) & (F.col(column) != "")).agg(F.countDistinct(column).alias(name))


def ranked_groups(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Groups by size, the largest first and ties by value."""
    return df.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def latest(df: DataFrame, order: list[str], n: int = 200) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def zero_filled(df: DataFrame, column: str, domain: list[str], name: str = "n") -> DataFrame:
    """Counts for every value of a closed domain, also those without rows."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = df.filter(F.col(column).isin(*domain)).groupBy(column).agg(F.count("*").alias(name))
    return values.join(counts, column, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def first_of_each(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key. A grouped minimum of (order, row): partly computed before the shuffle, so a key with
    many rows is no single task's."""
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    return df.groupBy(key.alias("_key")).agg(F.min(row).alias("_row")).select("_row.*").select(*df.columns)


def valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}$") & (F.length(c) <= 254), F.lit(False))


def insert_ignore(table: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows to append: the first of each key that the table doesn't have."""
    return first_of_each(rows, F.col(key), order).join(table.select(key), key, "left_anti")


def replay_limits(df: DataFrame, key: str, at: str, tie: str, limit: int, window: float) -> DataFrame:
    """df(key, at in seconds, tie) with allowed and retry_after, as a sliding-window limiter decides: hits that are denied
    don't count. Where a key has no hit for a window's time the limiter has forgotten all, so its hits are cut there, and each
    run of them comes to one task in order, one after another: a task holds limit times of one run, never a group. Cuts are found
    among the first and last hits of each key and stretch of a window's length."""
    ship(df.sparkSession)
    hits = df.select(key, at, tie).withColumn("_stretch", F.floor(F.col(at) / window))
    spans = hits.groupBy(key, "_stretch").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    of_key = Window.partitionBy(key).orderBy("_stretch")
    cut = F.coalesce(F.col("_first") - F.lag("_last").over(of_key) >= window, F.lit(True))
    runs = spans.withColumn("_run", F.sum(cut.cast("long")).over(of_key)).select(F.col(key).alias("_key"), F.col("_stretch").alias("_of"), "_run")
    hits = hits.join(runs, F.col(key).eqNullSafe(F.col("_key")) & F.col("_stretch").eqNullSafe(F.col("_of"))).select(key, at, tie, "_run")
    kind = df.select(key, at, tie).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", allowed boolean, retry_after long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = object(), deque()
        for frame in frames:
            allowed, wait = [], []
            for k, r, t in zip(frame[key], frame.pop("_run"), frame[at], strict=True):
                k = None if k != k else k  # a null key in pandas
                if (k, r) != current:
                    current, kept = (k, r), deque()
                ok, seconds = decide(kept, t, limit, window)
                allowed.append(ok)
                wait.append(seconds)
            yield frame.assign(allowed=allowed, retry_after=wait)

    return hits.repartition(F.col(key), F.col("_run")).sortWithinPartitions(key, "_run", at, tie).mapInPandas(run, schema)


def decide(kept, now: float, limit: int, window: float) -> tuple[bool, int]:
    """One hit: whether it is allowed, and else the seconds until one is. kept holds the times that count, oldest first."""
    while kept and kept[0] <= now - window:
        kept.popleft()
    if len(kept) >= limit:
        return False, int(kept[0] + window - now) + 1
    kept.append(now)
    return True, 0


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL event log; lines that aren't JSON are skipped, fields are cut to their lengths and have defaults."""
    raw = spark.read.schema("event string, path string, target string, session string, ts string, ua string").option("mode", "DROPMALFORMED").json(path)
    return clean_events(raw)


def clean_events(raw: DataFrame) -> DataFrame:
    """Page views and clicks only."""

    def cut(c: str, n: int, default: str | None = None) -> Column:
        v = F.substring(F.col(c), 1, n)
        return (F.coalesce(F.nullif(v, F.lit("")), F.lit(default)) if default else v).alias(c)

    return raw.filter(F.col("event").isin("pageview", "click")).select("event", cut("path", 200, "/"), cut("target", 100, "unknown"), cut("session", 64), F.try_to_timestamp("ts").alias("ts"), cut("ua", 300))


def event_report(events: DataFrame) -> dict[str, DataFrame]:
    views, clicks = events.filter("event = 'pageview'"), events.filter("event = 'click'")
    return {"pageviews": count_where(events, F.col("event") == "pageview"), "unique_sessions": distinct_where(views, "session"), "clicks": ranked_groups(clicks, "target"), "paths": ranked_groups(views, "path")}


def first_seen(df: DataFrame, value: str, row: str) -> DataFrame:
    """Rows that repeat a value, with the first row that has it."""
    some = df.filter(F.col(value).isNotNull()).select(row, value)
    first = some.groupBy(value).agg(F.min(row).alias("first_row"))
    return some.join(first, value).filter(F.col(row) > F.col("first_row")).select(row, value, "first_row")
