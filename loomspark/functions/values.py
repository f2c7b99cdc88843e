"""Value generators as column expressions of a row key.

Each takes the row key and the parts that name the draw (see draws). None shuffles; all stay in whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import below, bits, named, uniform

AS_OF = dt.date(2026, 1, 1)
WINDOW_DAYS = 730
#: How active each hour of the day is, 0 to 23.
HOUR_WEIGHTS = (2, 1, 1, 1, 1, 1, 2, 4, 6, 8, 9, 9, 10, 10, 9, 8, 8, 8, 9, 10, 9, 8, 6, 4)
WEEKEND_AGAIN = 0.6
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"


def integer(row: Column, lo: int, hi: int, *parts) -> Column:
    """From lo to hi, both included."""
    return F.lit(lo) + below(hi - lo + 1, row, *parts)


def numeric(row: Column, lo: Decimal, hi: Decimal, precision: int, scale: int, *parts) -> Column:
    """A decimal from lo to hi with that scale, drawn among the multiples of 10^-scale."""
    step = 10**scale
    first, last = int((lo * step).to_integral_value(rounding="ROUND_CEILING")), int((hi * step).to_integral_value(rounding="ROUND_FLOOR"))
    # wide ranges take two draws, so that every multiple can come up
    span = last - first + 1
    n = below(span, row, *parts) if span < 2**31 else F.pmod(bits(row, *parts) * F.lit(2**31) + bits(row, *parts, "low"), F.lit(span))
    return ((F.lit(first) + n).cast("decimal(38,0)") / F.lit(Decimal(step)).cast("decimal(20,0)")).cast(f"decimal({precision},{scale})")


def money(row: Column, lo: float, hi: float, precision: int, scale: int, *parts) -> Column:
    """Log-uniform from lo to hi with a charm ending: of 100 prices 70 end in .99, 15 in .95 and 15 in .00."""
    whole = F.floor(F.exp(F.lit(math.log(lo)) + uniform(row, *parts) * F.lit(math.log(hi) - math.log(lo)))).cast("long")
    r = below(100, row, *parts, "charm")
    cents = whole * 100 + F.when(r < 70, 99).when(r < 85, 95).otherwise(0)
    cents = F.greatest(F.lit(math.ceil(round(lo * 100, 6))), F.least(F.lit(math.floor(round(hi * 100, 6))), cents))
    return (cents.cast("decimal(38,0)") / F.lit(Decimal(100)).cast("decimal(20,0)")).cast(f"decimal({precision},{scale})")


def boolean(row: Column, p: float, *parts) -> Column:
    return uniform(row, *parts) < p


def uuid4(row: Column, *parts) -> Column:
    """A version 4 UUID; null if the row is."""
    h = F.md5(named(parts, row))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    dash, some = F.lit("-"), F.when(row.isNotNull(), F.lit(""))
    return F.concat(some, F.substring(h, 1, 8), dash, F.substring(h, 9, 4), dash, F.lit("4"), F.substring(h, 14, 3), dash, variant, F.substring(h, 18, 3), dash, F.substring(h, 21, 12))


def _days_back(row: Column, span: int, *parts) -> Column:
    """floor(span * u^2), in integers: recent days come up more often."""
    b = F.shiftright(bits(row, *parts), 2)  # 30 bits, so that the square fits
    return F.shiftright(F.shiftright(b * b, 30) * F.lit(span).cast("long"), 30)


def date(row: Column, lo: dt.date, hi: dt.date, *parts) -> Column:
    """hi less floor(span * u^2) days."""
    return F.date_sub(F.lit(hi), _days_back(row, (hi - lo).days, *parts).cast("int"))


def hour(row: Column, *parts) -> Column:
    """0 to 23 by HOUR_WEIGHTS."""
    r, total, out = below(sum(HOUR_WEIGHTS), row, *parts), 0, None
    for h, w in enumerate(HOUR_WEIGHTS[:-1]):
        total += w
        out = F.when(r < total, h) if out is None else out.when(r < total, h)
    return out.otherwise(23)


def timestamp(row: Column, lo: dt.datetime, hi: dt.datetime, *parts) -> Column:
    """As date, of two days the second where the first is on a weekend (six times in ten), at an active hour, from lo to hi."""
    day = date(row, lo.date(), hi.date(), *parts, "day")
    other = date(row, lo.date(), hi.date(), *parts, "again")
    day = F.when((F.weekday(day) >= 5) & (uniform(row, *parts, "weekend") < WEEKEND_AGAIN), other).otherwise(day)
    seconds = hour(row, *parts, "hour") * 3600 + below(3600, row, *parts, "second")
    at = F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + seconds).cast("timestamp_ntz")
    return F.greatest(F.lit(lo), F.least(F.lit(hi), at))


def choice(row: Column, values: list, *parts) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (below(len(values), row, *parts) + 1).cast("int"))


def weighted(row: Column, values: list, weights: list[int], *parts) -> Column:
    """One of values by integer weights."""
    r, total, out = below(sum(weights), row, *parts), 0, None
    for v, w in zip(values[:-1], weights[:-1], strict=True):
        total += w
        out = F.when(r < total, F.lit(v)) if out is None else out.when(r < total, F.lit(v))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


#: Word lists of our own.
WORDS = {
    "first_name": "Ada Bela Cora Dario Edna Falk Greta Henri Ines Jonas Kira Levi Mina Nils Olga Piet Runa Sven Tessa Uwe".split(),
    "last_name": "Abend Birk Colt Dahl Ebers Falke Grahn Holm Iver Jung Krog Lund Moor Nagel Orth Pohl Quast Rask Stahl Thorn".split(),
    "city": "Arvika Brunn Calden Dorrik Elstow Farnau Gorley Hestra Ilmen Jarrow".split(),
    "state": "North South East West Central".split(),
    "country": "Norland Sudria Estia Westmark Midgard".split(),
    "company": "Acorn Beacon Cinder Delta Ember Fjord Granite Harbor".split(),
    "job_title": "Analyst Builder Clerk Driver Editor Fitter Gardener Host".split(),
    "word": "amber basil cedar dune ember fern grove heath iris jade kelp larch moss nettle oak pine quartz reed sage thyme".split(),
}
FEMALE, MALE = "Ada Bela Cora Edna Greta Ines Kira Mina Olga Runa Tessa".split(), "Dario Falk Henri Jonas Levi Nils Piet Sven Uwe".split()


def text(row: Column, hint: str | None, limit: int | None, *parts) -> Column:
    """By the hint that the column's name gives, cut to limit characters."""
    pick = lambda name, salt: choice(row, WORDS[name], *parts, salt)
    number = below(10_000, row, *parts, "n")
    by_hint = {
        "email": lambda: F.concat(F.lower(pick("first_name", "a")), F.lit("."), F.lower(pick("last_name", "b")), number.cast("string"), F.lit("@example.com")),
        "phone": lambda: F.concat(F.lit("+1-555-"), F.lpad(number.cast("string"), 4, "0")),
        "full_name": lambda: F.concat_ws(" ", pick("first_name", "a"), pick("last_name", "b")),
        "street_address": lambda: F.concat_ws(" ", (number + 1).cast("string"), F.initcap(pick("word", "a")), F.lit("Street")),
        "zipcode": lambda: F.lpad(below(100_000, row, *parts, "zip").cast("string"), 5, "0"),
        "url": lambda: F.concat(F.lit("https://"), pick("word", "a"), number.cast("string"), F.lit(".example.com")),
        "ipv4": lambda: F.concat_ws(".", F.lit("10"), *[below(256, row, *parts, f"o{i}").cast("string") for i in range(3)]),
        "paragraph": lambda: F.concat(F.initcap(pick("word", "a")), F.lit(" "), F.concat_ws(" ", *[pick("word", f"w{i}") for i in range(8)]), F.lit(".")),
        "money": lambda: number.cast("string"),
        "gender": lambda: choice(row, ["female", "male", "nonbinary"], *parts),
        "tier": lambda: choice(row, ["budget", "mid", "premium"], *parts),
        "category": lambda: F.initcap(pick("word", "a")),
    }
    for name in ("first_name", "last_name", "city", "state", "country", "company", "job_title"):
        by_hint.setdefault(name, lambda name=name: pick(name, "a"))
    made = by_hint.get(hint, lambda: F.concat_ws(" ", F.initcap(pick("word", "a")), pick("word", "b"), pick("word", "c")))()
    return F.substring(made, 1, limit) if limit else made


def unique_text(made: Column, rank: Column, limit: int | None) -> Column:
    """made with its row's rank in base 36 behind it: no two rows are equal, and none is longer than limit."""
    tail = F.concat(F.lit("-"), base36(rank)) if not limit or limit > 8 else base36(rank)
    if not limit:
        return F.concat(made, tail)
    return F.concat(F.substr(made, F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.length(tail))), tail)


def present(rate: float, row: Column, *parts) -> Column:
    """Whether nullable() doesn't make a row's value null."""
    return uniform(row, *parts, "null") >= rate if rate > 0 else F.lit(True)


def nullable(made: Column, rate: float, row: Column, *parts) -> Column:
    """made, or null at that rate."""
    return F.when(present(rate, row, *parts), made) if rate > 0 else made


def derived(base: Column, op: str, row: Column, kind: str, *parts) -> Column:
    """A value for which "value op base" holds: 1 to 90 (days, for dates and times) away."""
    away = below(90, row, *parts, "away") + 1
    sign = 1 if op in (">", ">=") else -1
    if kind == "date":
        return F.date_add(base, (away * sign).cast("int"))
    if kind == "timestamp":
        return (F.timestamp_seconds(F.unix_seconds(base.cast("timestamp")) + away * 86400 * sign)).cast("timestamp_ntz")
    return base + away * sign
