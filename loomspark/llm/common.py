"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise, new_path, ship

__all__ = ["SPACE", "WORD", "for_python", "let", "materialise", "n_words", "new_path", "sampled", "ship", "starts", "table", "with_results"]

SPAN = 4096  # salts that are summed together

#: ASCII white space: what separates words.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_python(spark: SparkSession, rows: int = 100, size: str = "4m") -> None:
    """Before Python runs on texts: ships the package, and bounds Arrow batches in rows and bytes, as texts can be long; that
    bounds the workers' memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def sampled(value: Column, rows: int, n: int) -> Column:
    """Whether a hash of value falls below rows / n of its 2^64 values: about rows of n rows whatever n is."""
    if n <= rows:
        return F.lit(True)
    return F.xxhash64(value) < F.lit(-(2**63) + rows * 2**64 // n)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body repeats it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts(totals: DataFrame, groups: list[str], salt: str, value: str, name: str) -> DataFrame:
    """totals (a row per groups and salt, none of them null; best read from a file, as it is read twice) with name: the sum of value over the lesser salts of the
    same groups. Salts are summed by spans of SPAN, and spans then within their groups: of 5 * 10^7 salts no window has more than
    12,000 rows."""
    spans = totals.withColumn("_span", F.floor(F.col(salt) / SPAN))
    above = spans.groupBy(*groups, "_span").agg(F.sum(value).alias("_sum"))

    def before(column: str, by: list[str], order: str) -> Column:
        return F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    above = above.select(*groups, "_span", before("_sum", groups, "_span").alias("_above"))
    within = spans.withColumn("_own", before(value, [*groups, "_span"], salt))
    return within.join(above, [*groups, "_span"]).withColumn(name, F.col("_above") + F.col("_own")).drop("_span", "_above", "_own")


def n_words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_results(df: DataFrame, inputs: list[Column], results: T.StructType, make: Callable[..., list[pa.Array]]) -> DataFrame:
    """df with the columns that make(*inputs) returns for an Arrow batch. Columns of df that are named like one of results give
    way; the others pass through unread, whatever their names."""
    kept = [f for f in df.schema if f.name not in results.names]
    plain = [f"_{i}" for i in range(len(kept))]
    names = [*plain, *[f"r{i}" for i in range(len(results))]]
    rows = df.select(*[F.col(f"`{f.name}`").alias(p) for f, p in zip(kept, plain, strict=True)], *[c.alias(f"i{i}") for i, c in enumerate(inputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(plain)], *make(*batch.columns[len(plain) :])], names)

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, [*kept, *results], strict=True)])
    return rows.mapInArrow(run, schema).toDF(*[f.name for f in kept], *results.names)
