"""Keyed permutations of 0 to n - 1 as column expressions: ranks, shuffles and unique draws without a sort, a window or a join.

A number is a pair of digits (x, y), x below a and y below b, where a * b is n or a little more. ROUNDS rounds of a
Feistel network add a hash of one digit to the other, so pairs are permuted. a is chosen so that few pairs are n or more; where one of
those comes out, the network is walked on until the result is below n, which is done once on the driver for all of them. n is
at most MOST. The *_sql function gives the same for n rows that only a query knows, as DuckDB SQL.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import below, below_sql

MOST = 2**62
ROUNDS = 4
TRIED = 20_000  # values of a
WALKED = 3  # times at most, in the SQL of the tests


class Permutation:
    def __init__(self, n: int, *parts):
        self.n, self.parts = max(1, n), parts
        if self.n > MOST:
            raise ValueError(f"{n} numbers are more than can be permuted")
        root = math.isqrt(self.n - 1) + 1
        self.a = min(range(max(1, root // 2, root - TRIED), root + 1), key=lambda a: (-self.n % a, -a))
        self.b = -(-self.n // self.a)
        outside = range(self.n, self.a * self.b)
        self._on = [self._walk(z, 1) for z in outside]
        self._back = [self._walk(z, -1) for z in outside]

    def _walk(self, z: int, way: int) -> int:
        while z >= self.n:
            z = self.step(z, way)
        return z

    def _hash(self, n: int, digit: int, r: int) -> int:
        text = "|".join([*map(str, self.parts), f"round{r}", str(digit)])
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) * n >> 32

    def step(self, z: int, way: int = 1) -> int:
        """One pass of the network over a number, or over its result if way is -1."""
        x, y = divmod(z, self.b)
        for r in range(ROUNDS)[::way]:
            if r % 2:
                y = (y + way * self._hash(self.b, x, r)) % self.b
            else:
                x = (x + way * self._hash(self.a, y, r)) % self.a
        return x * self.b + y

    def _network(self, z: Column, way: int) -> Column:
        x, y = F.call_function("div", z, F.lit(self.b).cast("long")), F.pmod(z, F.lit(self.b).cast("long"))
        for r in range(ROUNDS)[::way]:
            if r % 2:
                y = F.pmod(y + way * below(self.b, x, *self.parts, f"round{r}"), F.lit(self.b).cast("long"))
            else:
                x = F.pmod(x + way * below(self.a, y, *self.parts, f"round{r}"), F.lit(self.a).cast("long"))
        return x * self.b + y

    def _within(self, made: Column, walked: list[int]) -> Column:
        if not walked:
            return made
        # a sum and no branch: Spark computes what a column repeats once only outside of branches and lambdas
        away = F.array(*[F.lit(w).cast("long") for w in (0, *(w - self.n - k for k, w in enumerate(walked)))])
        return made + F.get(away, F.greatest(made - (self.n - 1), F.lit(0).cast("long")).cast("int"))

    def of(self, i: Column) -> Column:
        """Where i (from 0 to n - 1) goes."""
        return self._within(self._network(i.cast("long"), 1), self._on)

    def back(self, j: Column) -> Column:
        """What goes to j."""
        return self._within(self._network(j.cast("long"), -1), self._back)


def permute_sql(name: str, n: str, *parts) -> str:
    """CTEs whose last, name(i, j), has where each i from 0 to n - 1 goes; n is SQL for a number."""

    def network(z: str) -> str:
        x, y = f"{z} // b", f"{z} % b"
        for r in range(ROUNDS):
            if r % 2:
                y = f"({y} + {below_sql('b', f'({x})', *parts, f'round{r}')}) % b"
            else:
                x = f"({x} + {below_sql('a', f'({y})', *parts, f'round{r}')}) % a"
        return f"({x}) * b + ({y})"

    root = "(CAST(floor(sqrt(n - 1)) AS BIGINT) + 1)"
    out = f"""{name}_n AS (SELECT CAST({n} AS BIGINT) AS n), {name}_a AS (SELECT n, arg_min(a, (-n % a + a) % a * 1000000 + 1000000 - a) AS a FROM (SELECT n, unnest(range(greatest(1, {root} // 2, {root} - {TRIED}), {root} + 1)) AS a FROM {name}_n) GROUP BY n),
 {name}_s AS (SELECT n, CAST(a AS BIGINT) AS a, CAST((n + a - 1) // a AS BIGINT) AS b FROM {name}_a),
 {name}_0 AS (SELECT i, n, a, b, {network("i")} AS j FROM (SELECT unnest(range(n)) AS i, n, a, b FROM {name}_s)),"""
    for k in range(WALKED):
        out += f"\n {name}_{k + 1} AS (SELECT i, n, a, b, CASE WHEN j >= n THEN {network('j')} ELSE j END AS j FROM {name}_{k}),"
    return out + f"\n {name} AS (SELECT i, CAST(j AS BIGINT) AS j FROM {name}_{WALKED})"
