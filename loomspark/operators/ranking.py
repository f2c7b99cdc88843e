"""Global ranks and running totals without a global sort.

Rows are put into buckets of buckets that follow the order, coarse ones first. Totals of the finest are a table, whose running
sums within the next coarser ones, up to the whole, give each bucket its start; within a bucket a window does the rest. Tasks are
as many as buckets. Row numbers have 2^16 rows in a window; days of minutes have 10^5 in a minute where a day has 1.4 * 10^8 rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(columns: list[str], other: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(c + other)) for c in columns])


def _starts(totals: DataFrame, levels: list[str]) -> DataFrame:
    """totals(levels, _sum) as (levels, _start): the sum of all buckets before each."""
    before = Window.partitionBy(*levels[:-1]).orderBy(F.col(levels[-1]).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    within = totals.select(*levels, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    if len(levels) == 1:
        return within
    above = _starts(totals.groupBy(*levels[:-1]).agg(F.sum("_sum").alias("_sum")), levels[:-1])
    above = above.select(*[F.col(c).alias(c + "_up") for c in levels[:-1]], F.col("_start").alias("_start_up"))
    return within.join(above, _same(levels[:-1], "_up")).select(*levels, (F.col("_start") + F.col("_start_up")).alias("_start"))


def running_total(df: DataFrame, value: Column, buckets: list[Column], order: list[Column], name: str) -> DataFrame:
    """Adds name: the sum of value over the rows up to this one. buckets must not fall as order rises, each within the one before
    it; order must tell all rows apart."""
    levels, columns = [f"_bucket{i}" for i in range(len(buckets))], df.columns
    df = df.withColumns(dict(zip(levels, buckets, strict=True)) | {"_value": value})
    starts = _starts(df.groupBy(*levels).agg(F.sum("_value").alias("_sum")), levels).withColumnsRenamed({c: c + "_of" for c in levels})
    within = Window.partitionBy(*levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.withColumn("_own", F.sum("_value").over(within)).join(starts, _same(levels, "_of"))
    return joined.select(*[F.col(f"`{c}`") for c in columns if c != name], (F.col("_start") + F.col("_own")).alias(name))


def number_rows(df: DataFrame, buckets: list[Column], order: list[Column], name: str) -> DataFrame:
    """Adds name: 1, 2, 3 ... in that order."""
    return running_total(df, F.lit(1).cast("long"), buckets, order, name)


FEW = 10_000_000  # rows for which one level of buckets will do


def time_buckets(at: Column) -> list[Column]:
    """Days and their minutes."""
    return [F.to_date(at), F.date_trunc("minute", at)]


def row_buckets(row: Column, n: int | None = None) -> list[Column]:
    """Buckets of n row numbers."""
    return [F.shiftright(row, 26), F.shiftright(row, 16)][0 if n is None or n >= FEW else 1 :]
