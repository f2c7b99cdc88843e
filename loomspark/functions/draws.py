"""Counter-based randomness: every draw is a hash of seed, table, column, salt and row key.

A draw depends on nothing else, so results are the same however rows are partitioned, and an SQL engine with MD5 can
recompute them. The *_sql functions give the same expressions as DuckDB SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def named(parts: tuple, row: Column) -> Column:
    """The text that a draw hashes: parts and row with bars between, without the row if that is null."""
    head = "|".join(map(str, parts))
    return F.coalesce(F.concat(F.lit(f"{head}|" if parts else ""), row.cast("string")), F.lit(head))


def bits(row: Column, *parts) -> Column:
    """32 random bits of a row as a long; parts (seed, table, column, salt ...) name the draw."""
    return F.conv(F.substring(F.md5(named(parts, row)), 1, 8), 16, 10).cast("long")


def uniform(row: Column, *parts) -> Column:
    """A double from 0 up to, but less than, 1."""
    return bits(row, *parts) / F.lit(4294967296.0)


def below(n: Column | int, row: Column, *parts) -> Column:
    """A long from 0 to n - 1, without rounding; n is less than 2^31."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    return F.shiftright(bits(row, *parts) * n, 32)


def _text_sql(parts: tuple, row: str) -> str:
    return "concat_ws('|', " + ", ".join(f"'{p}'" for p in parts) + f", CAST({row} AS VARCHAR))"


def bits_sql(row: str, *parts) -> str:
    return f"CAST('0x' || substr(md5({_text_sql(parts, row)}), 1, 8) AS BIGINT)"


def uniform_sql(row: str, *parts) -> str:
    return f"({bits_sql(row, *parts)} / CAST(4294967296.0 AS DOUBLE))"


def below_sql(n: str | int, row: str, *parts) -> str:
    return f"(({bits_sql(row, *parts)} * CAST({n} AS BIGINT)) >> 32)"
