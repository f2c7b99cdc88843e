"""Mixing sources to target weights under a time-varying curriculum, in DataFrame operations only.

A schedule gives every source a weight over training time 0 to 1 as straight lines between knots. Its integral
is the source's weight. Weights share the words to take; no source gives more than ``repeats`` times its words,
and what is cut off goes to the others by weight until nobody is above (closed form: sources sorted by cap over
weight, running sums). Within a source documents come in the order of a hash of their key, again and again
until the target is reached; the last one taken gives only the words still wanted. Inverting the source's
cumulative weight at the words taken before it gives each copy its training position, and documents are sorted
by range of position.

Running sums within a source are made from sums per (source, salt), so a source that holds a third of all rows
is spread over many tasks.

Defined results: a null text counts no words; a null source is a source of its own, sorted last; documents
without words are taken with 0 words and have no position; rows with a null key come in the order of a hash of their
text, so that they spread over salts as others do; equal rows share one order and split what is taken between them; an empty table gives an empty one. Extra columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words, starts

WEIGHTS = (1.0, 2.0, 3.0)
#: Training time and share of the weight at that time, for each weight of WEIGHTS in turn: the light sources fade, the heavy ones
#: grow. The integral of each is 1.
CURVES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
REPEATS = 3
ROWS_A_TASK = 2_000


def schedules(sources: DataFrame) -> DataFrame:
    """Adds knots array<struct<t, w>> to one row per source: WEIGHTS, repeating, by code point of the source with null last."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    curves = [F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w * weight).alias("w")) for t, w in curve]) for weight, curve in zip(WEIGHTS, CURVES, strict=True)]
    return sources.withColumn("knots", F.element_at(F.array(*curves), place.cast("int") + 1))


def integrate(knots: Column) -> Column:
    """knots with the integral up to each knot: array<struct<t, w, area>>."""
    start = F.array(F.struct(F.element_at(knots, 1)["t"].alias("t"), F.element_at(knots, 1)["w"].alias("w"), F.lit(0.0).alias("area")))

    def step(done: Column, knot: Column) -> Column:
        last = F.element_at(done, -1)
        area = last["area"] + (knot["t"] - last["t"]) * (knot["w"] + last["w"]) / 2
        return F.concat(done, F.array(F.struct(knot["t"].alias("t"), knot["w"].alias("w"), area.alias("area"))))

    return F.aggregate(F.slice(knots, 2, F.greatest(F.size(knots) - 1, F.lit(0))), start, step)


def position(knots: Column, share: Column) -> Column:
    """The time at which an integrated schedule has given that share of its whole area."""
    area = share * F.element_at(knots, -1)["area"]
    at = F.greatest(F.size(F.filter(knots, lambda x: x["area"] <= area)), F.lit(1))
    a, b = F.get(knots, at - 1), F.get(knots, F.least(at, F.size(knots) - 1))
    span = b["t"] - a["t"]
    slope = F.when(span > 0, (b["w"] - a["w"]) / span).otherwise(0.0)
    more = F.greatest(area - a["area"], F.lit(0.0))
    # w t + slope t^2 / 2 = more, in the form that also holds for a slope of 0
    root = F.sqrt(F.greatest(a["w"] * a["w"] + 2 * slope * more, F.lit(0.0)))
    return F.when(more > 0, a["t"] + 2 * more / (a["w"] + root)).otherwise(a["t"])


def allocate(sources: DataFrame, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """sources(source, source_size, knots) with integrated knots, weight and target. A row per source: small beside the documents."""
    s = sources.withColumn("knots", integrate(F.col("knots"))).withColumn("weight", F.element_at("knots", -1)["area"])
    s = s.withColumn("_cap", F.col("source_size") * repeats)
    order = [F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before, after, every = (Window.orderBy(*order).rowsBetween(*x) for x in ((Window.unboundedPreceding, -1), (0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    wanted = F.sum("source_size").over(every) * share
    level = (wanted - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(after)  # if this one and those after it aren't cut
    s = s.withColumn("_level", level)
    level = F.max(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))).over(every)  # the first that holds; later ones are lower
    return s.withColumn("_level", level).withColumn("target", F.coalesce(F.least(F.col("_level") * F.col("weight"), F.col("_cap").cast("double")), F.col("_cap").cast("double"))).drop("_cap", "_level")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (), repeats: int = REPEATS, share: float = 1.0, schedule=schedules) -> DataFrame:
    """key, source, size, source_size, target, taken, position of the first copy, and the columns of carry, a row per row of
    df. schedule adds knots to a table of sources; another one can join a table of its own."""
    s, t = F.col(f"`{source}`"), F.col(f"`{text}`")
    sized = df.select(
        F.col(f"`{key}`").alias(key), s.alias("source"), n_words(t).alias("size"), F.coalesce(s.cast("string"), F.lit("")).alias("_s"), s.isNull().alias("_u"),
        F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.xxhash64(t).cast("string"))).alias("_order"), F.xxhash64(t).alias("_tie"), *carry,
    )
    if not carry:  # a few small columns: texts are then read once
        sized = materialise(sized, "sizes")
    salts = max(1, (df if carry else sized).count() // ROWS_A_TASK)
    # the first 8 hex digits, so that salts are ranges of the order
    sized = sized.withColumn("_salt", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * salts / F.lit(2**32)).cast("int"))

    groups = ["_s", "_u", "_salt"]
    counted = materialise(sized.groupBy(*groups).agg(F.sum("size").alias("_size"), F.first("source").alias("source")), "salts")
    sources = allocate(schedule(counted.groupBy("_s", "_u").agg(F.sum("_size").alias("source_size"), F.first("source").alias("source"))), repeats, share)
    plan = starts(counted, ["_s", "_u"], "_salt", "_size", "_before").drop("_size", "source").join(sources.drop("source"), ["_s", "_u"])

    within = Window.partitionBy(*groups).orderBy("_order", key, "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(plan, groups)
    start, goal = F.col("_before") + F.col("_within"), F.floor(F.col("target") + 0.5)
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("source_size") * i - start)) for i in range(repeats)), F.lit(0)).cast("long")
    at = F.when((F.col("size") > 0) & (start < goal), position(F.col("knots"), start / goal))
    return placed.select(key, "source", "size", "source_size", "target", taken.alias("taken"), at.alias("position"), "_order", start.alias("_start"), goal.alias("_goal"), "knots", *[c for c in carry])


def in_order(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sorted by position over ranges; the hash spreads rows without a position."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "_order", key)


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", repeats: int = REPEATS) -> DataFrame:
    """The rows of df in training order, each as often as the mix takes it (taken / size, rounded half up; rows without
    words once), with the columns of df only."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), F.col(f"`{source}`").alias("_source_of"))
    mixed = mix(row, "_key", "_text", "_source_of", ("_row",), repeats)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int"))
    copied = mixed.withColumn("_copies", copies).filter("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    source_size = F.col("source_size")
    at = F.when((F.col("size") > 0), position(F.col("knots"), F.least((F.col("_start") + F.col("_epoch") * source_size) / F.col("_goal"), F.lit(1.0))))
    return copied.select("_row", at.alias("position"), "_order", F.col("_key")).orderBy(F.col("position").asc_nulls_last(), "_order", "_key").select("_row.*")
