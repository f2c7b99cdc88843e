"""Columns of a solved system of comparisons as expressions of a row, each drawn between the bounds that earlier ones leave."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import below
from ..plans.differences import System
from ..plans.model import WHOLE
from . import coherence as C

AWAY = 90  # units that a column is from the one it follows, at most


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long")) if b != 1 else a


def to_units(system: System, column: str, value: Column) -> Column:
    c = system.table.row[column]
    kind = c.metadata["sql"]
    if system.scale is None:
        return F.unix_date(value.cast("date")).cast("long") * 86400 if kind == "DATE" else C.seconds(value)
    if kind in WHOLE:
        return value.cast("long") * system.step(column)
    if kind == "FLOAT":
        return F.round(value.cast("double") * 100).cast("long") * system.step(column)
    digits = c.dataType.scale
    return (value.cast(f"decimal(28,{digits})") * F.lit(Decimal(10**digits)).cast("decimal(10,0)")).cast("long") * system.step(column)


def from_units(system: System, column: str, units: Column) -> Column:
    c = system.table.row[column]
    kind = c.metadata["sql"]
    if system.scale is None:
        return F.date_from_unix_date(_div(units, 86400).cast("int")) if kind == "DATE" else C.moment(units)
    steps = _div(units, system.step(column))
    if kind in WHOLE:
        return steps.cast(c.dataType)
    if kind == "FLOAT":
        return steps.cast("double") / 100
    return (steps.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-c.dataType.scale))).cast(c.dataType)


def _most(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def _least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


Bind = Callable[[Column, Callable[[Column], object]], object]


class Steps:
    """Binds each value as a column of rows."""

    def __init__(self, rows: DataFrame, name: str = "_step"):
        self.rows, self.name, self.n = rows, name, 0

    def column(self, value: Column) -> Column:
        self.n += 1
        self.rows = self.rows.withColumn(f"{self.name}{self.n}", value)
        return F.col(f"{self.name}{self.n}")

    def __call__(self, value: Column, body: Callable[[Column], object]):
        return body(self.column(value))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once though body repeats it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchor_for(system: System, x: str, drawn: list[str], distinct: set[str]) -> tuple[str, int] | None:
    """For a column of distinct values: one of distinct values that is drawn before it, and how far from that it is to be."""
    above, under = system.near(x, drawn)
    return next(((y, w) for y, w in above if y in distinct), None) or next(((z, -w) for z, w in under if z in distinct), None)


def unsettled(system: System, given: set[str], distinct: set[str]) -> list[tuple[str, str]]:
    """The pairs of columns whose comparison draw() doesn't ensure: of given or listed values, or of distinct ones that aren't kept at
    a distance."""
    listed = {c.name for c in system.table.row if c.metadata.get("domain") is not None}
    out, drawn = [], []
    for x in system.columns:
        if x in given or x in listed or x in distinct and not anchor_for(system, x, drawn, distinct):
            out += [(x, y) for y in drawn if system.binds(x, y) or system.binds(y, x)]
        drawn.append(x)
    return out


def draw(system: System, given: dict[str, Column], own: Callable[[str, tuple], Column], distinct: set[str], row: Column, bind: Bind, then: Callable[[dict[str, Column]], object], *parts):
    """then(values, without nulls, of the columns that aren't given). own(column, limits) draws a column by itself; bind(value, body)
    is body(value) with the value computed once. Values of distinct columns differ from row to row, so each after the first is a fixed
    distance from one before it. A null among what is given binds nothing. Where what is given leaves no room, the value is null."""
    listed = {c.name for c in system.table.row if c.metadata.get("domain") is not None}
    none = F.lit(None).cast("long")

    def alone(x: str, more: Callable[[Column, Column], object]):
        return bind(own(x, system.limits(x)), lambda v: more(v, to_units(system, x, v)))

    def go(left: list[str], units: dict[str, Column], made: dict[str, Column]):
        if not left:
            return then(made)
        x, rest = left[0], left[1:]

        def next_with(u: Column, v: Column):
            return go(rest, units | {x: u}, made | {x: v})

        above, under = system.near(x, list(units))
        at = anchor_for(system, x, list(units), distinct) if x in distinct else None
        if at:
            return bind(units[at[0]] + at[1], lambda u: next_with(u, from_units(system, x, u)))
        if x in distinct or x in listed or not above and not under:
            return alone(x, lambda v, u: next_with(u, v))
        low, high = system.interval(x)
        step, room = system.step(x), (AWAY - 1) * system.unit
        after = _most([units[y] + w for y, w in above]) if above else none
        before = _least([units[z] - w for z, w in under]) if under else none

        def between(ends: Column):
            lowest, highest = F.greatest(ends["after"], none if low is None else F.lit(low).cast("long")), F.least(ends["before"], none if high is None else F.lit(high).cast("long"))
            lowest, highest = lowest + F.pmod(-lowest, F.lit(step)), highest - F.pmod(highest, F.lit(step))
            first = F.when(ends["after"].isNotNull(), lowest).otherwise(F.greatest(lowest, highest - room))
            last = F.when(ends["after"].isNotNull(), F.least(highest, lowest + room)).otherwise(highest)
            return bind(F.struct(first.alias("first"), last.alias("last"), (ends["after"].isNull() & ends["before"].isNull()).alias("free")), among)

        def among(ends: Column):
            n = _div(ends["last"] - ends["first"], step) + 1
            near = F.when(ends["last"] >= ends["first"], ends["first"] + step * below(F.least(n, F.lit(2**31 - 1).cast("long")), row, *parts, x, "away"))
            if not set(y for y, _ in above + under) <= set(given):  # what is drawn here isn't null
                return bind(near, lambda u: next_with(u, from_units(system, x, u)))
            return alone(x, lambda _, u: bind(F.when(ends["free"], u).otherwise(near), lambda u: next_with(u, from_units(system, x, u))))

        return bind(F.struct(after.alias("after"), before.alias("before")), between)

    known = {c: to_units(system, c, v) for c, v in given.items() if c in system.columns}
    return go([c for c in system.columns if c not in known], known, {})
