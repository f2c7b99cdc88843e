"""Rate limits over streams against a replay in order."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspark.operators import stats
from loomspark.storage import new_path
from loomspark.streaming import events

SCHEMA = "rule string, key long, event_id long, at double"


def written(spark, batches):
    path = new_path(spark, "hits")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def outcome(rows):
    return {r["event_id"]: (r["allowed"], r["retry_after"]) for r in rows}


def test_event_time_limits_equal_a_replay(spark):
    """100,000 shuffled hits of one key in one batch, and others of two rules over batches out of order; the end of the stream comes later."""
    rng = random.Random(6)
    hot = [("login", 1, i, 1000 + rng.random() * 7200) for i in range(100_000)]
    rest = [(rng.choice(["login", "mail"]), rng.randrange(2, 5), 200_000 + i, 1000 + rng.random() * 7200) for i in range(300)]
    odd = [("other", 9, 300_000 + i, 1000.0 + i) for i in range(50)]
    rng.shuffle(hot)
    limits = {"login": (10, 3600.0), "mail": (3, 600.0)}
    far = [("login", 99, 999_999, 90_000.0)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        stream = written(spark, [hot + rest[:150] + odd, rest[150:], far])
        got = outcome(events.run_available(events.limited_by_event_time(stream, limits, "3 hours"), "event_time").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for rule, (limit, window) in limits.items():
        df = spark.createDataFrame([r[1:] for r in hot + rest if r[0] == rule], "key long, event_id long, at double")
        want |= outcome(stats.replay_limits(df, "key", "at", "event_id", limit, window).collect())
    want |= {r[2]: (True, 0) for r in odd}
    assert got == want and sum(a for a, _ in want.values()) < 1000


def test_state_is_empty_after_the_window(spark):
    stream = written(spark, [[("a", k, k, 1000.0 + k) for k in range(20)], [("a", 50, 50, 6000.0)], [("a", 51, 51, 50_000.0)]])
    out, checkpoint = new_path(spark, "out"), new_path(spark, "state")
    query = events.limited_by_event_time(stream, {"a": (2, 100.0)}, "1 second").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) >= 20 and states[-1] <= 4  # what is left is of the last hit, which no later one has released
    assert spark.read.parquet(out).count() == 21


def test_limiter_orders_hits_over_pieces(spark):
    rng = random.Random(2)
    hits = [("", 1, i, rng.random() * 500) for i in range(1000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = outcome(events.run_available(events.limited(written(spark, [hits]).drop("rule"), 3, 60.0), "pieces").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    df = spark.createDataFrame([r[1:] for r in hits], "key long, event_id long, at double")
    assert got == outcome(stats.replay_limits(df, "key", "at", "event_id", 3, 60.0).collect())


def test_limiter_runs_where_only_the_driver_finds_the_package(tmp_path):
    """The package is on sys.path, but neither on PYTHONPATH nor in the working folder."""
    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from loomspark.streaming import events
spark.createDataFrame([(1, 1, 0.0), (1, 2, 5.0)], "key long, event_id long, at double").write.parquet("file://{tmp_path}/hits")
stream = spark.readStream.schema("key long, event_id long, at double").parquet("file://{tmp_path}/hits")
print("ROWS", sorted(tuple(r) for r in events.run_available(events.limited(stream, 1, 60.0), "x").collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=300)
    assert "ROWS [(1, 1, 0.0, True, 0), (1, 2, 5.0, False, 56)]" in done.stdout, done.stderr[-2000:]
