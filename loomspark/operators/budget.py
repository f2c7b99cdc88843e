"""A wall-time budget for work on Spark: jobs that run over it are cancelled, and leave nothing running."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class BudgetExceeded(TimeoutError):
    """The work took longer than it may."""


def within(spark: SparkSession, seconds: float, work: Callable[[], object]) -> object:
    """What work returns, if its Spark jobs end within that time."""
    context, tag, over = spark.sparkContext, f"budget-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        out = work()
    except Exception as e:
        if over.is_set():
            raise BudgetExceeded(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    if over.is_set():
        raise BudgetExceeded(f"took more than {seconds} s")
    return out
