"""Hierarchies given by a parent column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def unrooted(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(key) of the rows from which no walk up the parents ends: rows of a cycle and rows that lead into one. A parent that is
    no row ends a walk.

    Pointer doubling: each round a row's pointer becomes its pointer's pointer, so walks of 2^k steps take k rounds; rows
    whose walk has ended drop out."""
    rows = df.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    known = rows.select("k")
    walks = materialise(rows.filter("p is not null").join(known.withColumnRenamed("k", "p"), "p", "left_semi").select("k", "p"), "walks")
    rounds = max(1, walks.count()).bit_length()
    for _ in range(rounds):
        nxt = walks.select(F.col("k").alias("p"), F.col("p").alias("q"))
        walks = materialise(walks.join(nxt, "p").select("k", F.col("q").alias("p")), "walks")
        if walks.isEmpty():
            break
    return walks.select(F.col("k").alias(key)).distinct()
