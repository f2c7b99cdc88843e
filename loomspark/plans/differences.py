"""Systems of column comparisons, solved before rows are made.

The comparisons of a table, left op right + offset, and the bounds of their columns are difference constraints x >= y + w
between columns and an origin that is 0. Columns that they connect are a system, counted in whole units: the finest step of
its numbers, or seconds. The longest paths between all pairs give each column's feasible interval, and for any two columns
the least distance that all constraints together ask for. With these distances (rounded to the columns' steps), columns can be drawn one after
another, coarse ones first: whatever has been drawn between its distances to those drawn before leaves room for the rest. A
cycle of positive weight leaves nothing, and raises DomainExhausted.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from itertools import product

from .model import TIMED, WHOLE, DomainExhausted, Table, bounds

ORIGIN = ""
FAR = 2**61  # of the origin, in units: beyond is open
DAY = 86400
USUAL = 11_000  # numbers are within it where nothing else is said, or within it of their only bound
EPOCH = dt.datetime(1970, 1, 1)
#: What the types hold.
HELD = {"SMALLINT": 2**15 - 1, "INTEGER": 2**31 - 1, "BIGINT": 2**63 - 1}


def solvable(table: Table, column: str) -> bool:
    c = table.row[column]
    return c.metadata["sql"] in (*WHOLE, *TIMED, "FLOAT") or c.metadata["sql"] == "NUMERIC" and c.dataType.scale <= 9


@dataclass
class System:
    """Columns in the order in which they are drawn; least[x, y]: the least x - y. declared: the same without what types can hold."""

    table: Table
    scale: int | None  # digits after the point; None: seconds
    columns: list[str]
    least: dict[tuple[str, str], int] = field(default_factory=dict)
    declared: System | None = None

    @property
    def unit(self) -> int:
        """1, or a day."""
        return DAY if self.scale is None else 10**self.scale

    def step(self, column: str) -> int:
        c = self.table.row[column]
        if self.scale is None:
            return DAY if c.metadata["sql"] == "DATE" else 1
        digits = 0 if c.metadata["sql"] in WHOLE else c.dataType.scale if c.metadata["sql"] == "NUMERIC" else 2
        return 10 ** (self.scale - digits)

    def units(self, value, up: bool) -> int:
        if self.scale is None:
            if isinstance(value, dt.timedelta):
                return value.days * DAY + value.seconds
            at = value if isinstance(value, dt.datetime) else dt.datetime.combine(value, dt.time())
            return (at - EPOCH).days * DAY + (at - EPOCH).seconds
        return int((Decimal(value) * 10**self.scale).to_integral_value(ROUND_CEILING if up else ROUND_FLOOR))

    def value(self, column: str, units: int):
        """Units as a value of the column's type."""
        if self.scale is None:
            at = EPOCH + dt.timedelta(seconds=units)
            return at.date() if self.table.row[column].metadata["sql"] == "DATE" else at
        return Decimal(units).scaleb(-self.scale)

    def limits(self, column: str) -> tuple:
        """(lowest, highest) feasible values; None where open. Limits of types count where they cut what is drawn by default."""
        low, high = (self.declared or self).interval(column)
        if self.declared and self.scale is not None:
            least, most = self.interval(column)
            usual = USUAL * self.unit
            cut_low = low is None and least is not None and least > (0 if high is None else high - usual)
            cut_high = high is None and most is not None and most < max(low or 0, 0) + usual
            if cut_high and low is None and most >= self.unit >= least:
                low = self.step(column)  # what is drawn by default is positive
            low, high = least if cut_low else low, most if cut_high else high
        first, last = (-(10**10), 2 * 10**11) if self.scale is None else (-FAR, FAR)
        return self.value(column, low) if low is not None and low > first else None, self.value(column, high) if high is not None and high < last else None

    def interval(self, column: str) -> tuple[int | None, int | None]:
        low, high = self.least.get((column, ORIGIN)), self.least.get((ORIGIN, column))
        return low, None if high is None else -high

    def binds(self, x: str, y: str) -> bool:
        """Whether x >= y + least[x, y] says more than the intervals of x and y do."""
        w, low, high = (self.least.get(p) for p in ((x, y), (x, ORIGIN), (ORIGIN, y)))
        return w is not None and (low is None or high is None or w > low + high)

    def near(self, column: str, drawn: list[str]) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
        """(columns drawn before that this one is so much above at least, those that it is so much below)."""
        above = [(y, self.least[column, y]) for y in drawn if self.binds(column, y)]
        below = [(y, self.least[y, column]) for y in drawn if self.binds(y, column)]
        return above, below

    def close(self) -> None:
        """Longest paths, and distances rounded up to what the steps allow, until nothing changes."""
        nodes = [ORIGIN, *self.columns]
        steps = {ORIGIN: max(self.step(c) for c in self.columns)} | {c: self.step(c) for c in self.columns}
        for _ in range(4 * len(nodes)):
            before = dict(self.least)
            for k, i, j in product(nodes, repeat=3):
                if (i, k) in self.least and (k, j) in self.least:
                    w = self.least[i, k] + self.least[k, j]
                    self.least[i, j] = max(w, self.least.get((i, j), w))
            for (i, j), w in self.least.items():
                s = min(steps[i], steps[j])
                self.least[i, j] = -(-w // s) * s
            if stuck := [i for i in nodes if self.least.get((i, i), 0) > 0]:
                raise DomainExhausted(f"{self.table.name}: no values satisfy the checks on {', '.join(c for c in stuck if c) or ', '.join(self.columns)} together")
            if self.least == before:
                return
        raise DomainExhausted(f"{self.table.name}: no values satisfy the checks on {', '.join(self.columns)} together")


def comparisons(table: Table) -> list[tuple]:
    """(left, op, right, offset) of all checks."""
    return [(*f[1:4], f[4] if len(f) > 4 else None) for c in table.checks for f in c.facts if f[0] == "compare"]


def systems(table: Table, first: list[str], ranges: dict[str, tuple], skipped: set[str] = frozenset()) -> list[System]:
    """The solved systems of a table's comparisons. first: columns whose values are there before, or are drawn on their own; ranges: what
    is known of such values. Columns of skipped, and pairs that aren't both numbers or both times, are left out."""
    edges = []
    for left, op, right, offset in comparisons(table):
        if {left, right} & skipped or not (solvable(table, left) and solvable(table, right)) or (table.row[left].metadata["sql"] in TIMED) != (table.row[right].metadata["sql"] in TIMED):
            continue
        edges.append((left, op, right, offset))
    group = {c: {c} for e in edges for c in (e[0], e[2])}
    for left, _, right, _ in edges:
        if group[left] is not group[right]:
            group[left] |= group[right]
            for c in group[left]:
                group[c] = group[left]
    lefts, out = {e[0] for e in edges}, []
    for members in {id(g): g for g in group.values()}.values():
        own = [c.name for c in table.row if c.name in members]
        scale = None if table.row[own[0]].metadata["sql"] in TIMED else max([0, *(2 if table.row[c].metadata["sql"] == "FLOAT" else table.row[c].dataType.scale for c in own if table.row[c].metadata["sql"] not in WHOLE)])
        system = System(table, scale, list(own))
        if scale is not None:  # offsets may be finer
            finest = max([0, *(-int(e[3].normalize().as_tuple().exponent) for e in edges if e[0] in members and e[3])])
            system.scale = min(9, max(scale, finest))
        # coarse ones first, those whose values are given before them, and what nothing is derived for
        system.columns.sort(key=lambda c: (c not in first, -system.step(c), c in lefts, own.index(c)))

        system.declared = System(table, system.scale, system.columns)

        def add(x: str, y: str, w: int, declared: bool = True, system=system) -> None:
            for s in (system, system.declared) if declared else (system,):
                if abs(w) < FAR:
                    s.least[x, y] = max(w, s.least.get((x, y), w))

        for c in own:
            low, high, listed = bounds(table, table.row[c])
            allowed = [v for v in (table.row[c].metadata.get("domain") or listed or ()) if not isinstance(v, str)]
            span = (min(allowed), max(allowed)) if allowed else ranges.get(c, ())
            kind = table.row[c].metadata["sql"]
            most = HELD.get(kind) if kind in WHOLE else 10 ** (table.row[c].dataType.precision - table.row[c].dataType.scale) - Decimal(1).scaleb(-table.row[c].dataType.scale) if kind == "NUMERIC" else None
            for v, declared in ((low, True), (span[0] if span else None, True), (None if most is None else -most, False)):
                if v is not None:
                    add(c, ORIGIN, system.units(v, True), declared)
            for v, declared in ((high, True), (span[1] if span else None, True), (most, False)):
                if v is not None:
                    add(ORIGIN, c, -system.units(v, False), declared)
        for left, op, right, offset in edges:
            if left not in members:
                continue
            if op[0] == "<":
                x, y, w = right, left, None if offset is None else -offset
            else:
                x, y, w = left, right, offset
            distance = 0 if w is None else system.units(w, True)
            if op in ("<", ">") and (w is None or system.units(w, False) == distance):
                distance += 1
            add(x, y, distance)
        system.close()
        system.declared.close()
        for c, (low, high) in ranges.items():  # all of these values come up, so each must be feasible
            if c in own:
                least, most = system.interval(c)
                if least is not None and least > system.units(low, True) or most is not None and most < system.units(high, False):
                    raise DomainExhausted(f"{table.name}.{c}: not all values from {low} to {high} satisfy the checks on {', '.join(own)} together")
        out.append(system)
    return out
