"""How many rows each table gets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.draws import below
from .graph import Plan
from .model import Schema, SchemaError


class ConfigError(SchemaError):
    """A setting that can't hold."""


@dataclass(frozen=True)
class Fanout:
    """low to high children for each row of parent."""

    low: int
    high: int
    parent: str

    def children(self, parent_row: Column, seed: int, child: str) -> Column:
        return (F.lit(self.low) + below(self.high - self.low + 1, parent_row, seed, "fanout", child)).cast("int")


def parse_rows(text: str | int) -> int | Fanout:
    """12, "5..20 per users" or "5..20/users"."""
    s = str(text).strip()
    if re.fullmatch(r"[+-]?\d+", s):
        if int(s) < 0:
            raise ConfigError(f"row count {s} is negative")
        return int(s)
    m = re.fullmatch(r"(\d+)\s*\.\.\s*(\d+)\s*(?:/|\s+per\s+)\s*([A-Za-z_][\w$]*)", s)
    if not m:
        raise ConfigError(f"row count {text!r} is neither a number nor LOW..HIGH per PARENT")
    if int(m[1]) > int(m[2]):
        raise ConfigError(f"row count {text!r}: {m[1]} is above {m[2]}")
    return Fanout(int(m[1]), int(m[2]), m[3])


def check_fanout(schema: Schema, plan: Plan, table: str, spec: Fanout, known: set[str]) -> None:
    """A fan-out needs exactly one single-column key to a parent that has a row count and isn't deferred."""
    if spec.parent == table:
        raise ConfigError(f"{table} can't fan out over itself; the share of roots shapes hierarchies")
    if spec.parent not in schema:
        raise ConfigError(f"{table} fans out over {spec.parent}, which is not in the schema")
    keys = [fk for fk in schema[table].references if fk.table == spec.parent]
    if len(keys) != 1:
        raise ConfigError(f"{table} has {len(keys)} foreign keys to {spec.parent}; a fan-out needs one")
    if len(keys[0].columns) != 1:
        raise ConfigError(f"the foreign key of {table} to {spec.parent} is composite; a fan-out needs a single column")
    if any(t == table and fk is keys[0] for t, fk in plan.deferred):
        raise ConfigError(f"the foreign key of {table} to {spec.parent} is part of a cycle and filled in later")
    if spec.parent not in known:
        raise ConfigError(f"{table} fans out over {spec.parent}, which has no row count")


def integer_plan(schema: Schema, order: list[str], base: int) -> dict[str, int]:
    """base rows for tables without parents; three times the largest parent for others, but ten times base at most."""
    counts: dict[str, int] = {}
    for name in order:
        parents = [counts[fk.table] for fk in schema[name].references if fk.table in counts and fk.table != name]
        counts[name] = min(3 * max(parents), 10 * base) if parents else base
    return counts


def capped_plan(counts: dict[str, int], cap: int = 1000) -> dict[str, int]:
    """counts scaled down to cap rows together: rounded down, one at least, and what is still too much off the largest."""
    total = sum(counts.values())
    if total <= cap:
        return dict(counts)
    out = {t: max(1, n * cap // total) for t, n in counts.items()}
    while sum(out.values()) > cap and max(out.values()) > 1:
        largest = max(out, key=lambda t: out[t])
        out[largest] -= 1
    return out


#: Caps of a public service.
MAX_DDL, MAX_TABLES, MAX_COLUMNS, MAX_ROWS = 50_000, 15, 120, 1000


def check_caps(schema: Schema, ddl: str = "", rows: int = 1) -> None:
    """Raises ConfigError for a schema or a request that is larger than a public service takes."""
    columns = sum(len(t.row) for t in schema.values())
    for what, n, most in (("bytes of DDL", len(ddl.encode()), MAX_DDL), ("tables", len(schema), MAX_TABLES), ("columns", columns, MAX_COLUMNS), ("rows", rows, MAX_ROWS)):
        if n > most:
            raise ConfigError(f"{n} {what}; the most is {most}")
    if not schema:
        raise ConfigError("there is no table")
