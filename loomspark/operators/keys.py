"""Foreign keys: which parent each child row gets.

Parents and children come with a row number (1, 2, 3 ...) in column "rid"; picks are parents' row numbers, so keys
and anchors follow by one equi-join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import below, uniform
from ..functions.permute import MOST, Permutation
from ..plans.model import DomainExhausted
from ..storage import materialise
from .ranking import number_rows, row_buckets, running_total, time_buckets

ZIPF = 0.7


def uniform_pick(n_parents: int, rid: Column, *parts) -> Column:
    """Each parent as likely."""
    return below(n_parents, rid, *parts) + 1


def permuted_pick(n_parents: int, n_children: int, rid: Column, *parts) -> Column:
    """Different parents for different children: for a unique foreign key."""
    if n_children > n_parents:
        raise DomainExhausted(f"{n_children} rows need different parents, and there are {n_parents}")
    return Permutation(n_parents, *parts).of(rid - 1) + 1


def zipf_pick(children: DataFrame, m: int, *parts) -> DataFrame:
    """children with pick: m parents, of which that of rank r weighs 1 / r^0.7; a permutation gives their ranks.

    Weights are whole millionths. A child draws a place in their sum; ranks' intervals and children's places are cut
    into as many bins as there are ranks, so that the range join is an equi-join on the bin. A bin holds a few ranks only, as the least
    weight is a third of the mean. The table of ranks depends on m alone; parents are not read."""
    if not m:
        return children.withColumn("pick", F.lit(None).cast("long"))
    ranks = children.sparkSession.range(1, m + 1).select(F.col("id").alias("_rank"))
    weight = F.greatest(F.lit(1), F.floor(F.lit(1e6) * F.pow(F.col("_rank").cast("double"), F.lit(-ZIPF)))).cast("long")
    summed = running_total(ranks.withColumn("_w", weight), F.col("_w"), row_buckets(F.col("_rank"), m), [F.col("_rank")], "_hi")
    summed = materialise(summed.select((ranked(m, *parts).back(F.col("_rank") - 1) + 1).alias("pick"), "_w", "_hi"), "zipf")
    total = summed.agg(F.max("_hi")).first()[0]
    width = max(1, total // max(1, m))
    low = F.col("_hi") - F.col("_w")
    binned = summed.select("pick", low.alias("_lo"), "_hi", F.explode(F.sequence(F.floor(low / width), F.floor((F.col("_hi") - 1) / width))).alias("_bin"))
    placed = children.withColumn("_x", below(total, F.col("rid"), *parts)).withColumn("_bin", F.floor(F.col("_x") / width))
    return placed.join(binned, "_bin").filter("_x >= _lo and _x < _hi").drop("_x", "_bin", "_lo", "_hi")


def ranked(m: int, *parts) -> Permutation:
    """Of m parents' row numbers less 1: their ranks less 1."""
    return Permutation(m, *parts, "rank")


BLOCK = 256  # parents whose children are counted together
PIECE = 100_000  # children of a file of blocks, which are too few bytes for Spark to split one file among tasks


def allocate(spark: SparkSession, m: int, n_children: Callable[[Column], Column], *parts) -> tuple[DataFrame, int]:
    """(rid, pick, place) and how many: parent p of 1 to m gets exactly n_children(p) children, numbered in the order of a shuffle;
    place counts a parent's children from 1. Children are counted by blocks of parents, from row numbers alone; sums of
    blocks give each block's first child, and a permutation shuffles. No row of a parent or child is shuffled or sorted."""
    first = F.col("id") * BLOCK + 1
    counts = F.transform(F.sequence(first, F.least(first + BLOCK - 1, F.lit(m).cast("long"))), lambda p: n_children(p).cast("long"))
    blocks = materialise(spark.range(-(-m // BLOCK)).select("id", counts.alias("_counts")), "blocks")
    summed = blocks.select("id", F.aggregate("_counts", F.lit(0).cast("long"), lambda a, k: a + k).alias("_n"))
    ends = materialise(running_total(summed, F.col("_n"), row_buckets(F.col("id")), [F.col("id")], "_end").select("id", "_n", "_end"), "ends")
    total = ends.agg(F.coalesce(F.max("_end"), F.lit(0))).first()[0]
    pieces = max(-(-total // PIECE), min(spark.sparkContext.defaultParallelism, -(-m // BLOCK)), 1)
    # how many children come before each parent of the block
    before = F.aggregate("_counts", F.array(F.col("_end") - F.col("_n")), lambda a, k: F.concat(a, F.array(F.element_at(a, -1) + k)))
    each = materialise(blocks.join(ends, "id").repartition(pieces, "id"), "pieces").select("id", "_counts", before.alias("_before"))
    each = each.select(first.alias("_first"), F.posexplode(F.arrays_zip(F.col("_counts").alias("k"), F.slice("_before", 1, F.size("_counts")).alias("before"))).alias("_pos", "_p"))
    each = each.select((F.col("_first") + F.col("_pos")).alias("pick"), F.col("_p.before").alias("_before"), F.col("_p.k").alias("_k")).filter("_k > 0")
    each = each.select("pick", "_before", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))).alias("place"))
    return each.select((Permutation(total, *parts, "order").of(F.col("_before") + F.col("place") - 1) + 1).alias("rid"), "pick", "place"), total


def multiplier(n: int) -> int:
    """A step that visits all of n cells: coprime to n, near n times the golden ratio, but under 2^31."""
    a = max(1, min(int(n * 0.6180339887), 2**31 - 1))
    while math.gcd(a, n) != 1:
        a += 1
    return a


def cells(sizes: list[int], n: int, rid: Column, *parts) -> list[Column]:
    """Row numbers (from 1) in each of several domains, so that no two of n rows have the same combination. Where there are more
    combinations than can be permuted, the first domains that have n of them are, and the others are drawn freely."""
    if n > math.prod(sizes):
        raise DomainExhausted(f"{n} rows need different combinations, and there are {math.prod(sizes)}")
    k = len(sizes)
    if math.prod(sizes) > MOST:
        k = next(k for k in range(1, k + 1) if math.prod(sizes[:k]) >= n)
    cell, out = Permutation(math.prod(sizes[:k]), *parts).of(rid - 1), []
    for size in reversed(sizes[:k]):
        out.append((F.pmod(cell, F.lit(size)) + 1).cast("long"))
        cell = F.call_function("div", cell, F.lit(size).cast("long"))
    return out[::-1] + [below(size, rid, *parts, f"free{i}") + 1 for i, size in enumerate(sizes[k:])]


def forest_parents(rows: DataFrame, root_fraction: float, *parts) -> DataFrame:
    """rows(rid, anchor) with parent: the rid of a row that comes before in order of (anchor, rid), null for roots. No
    cycle can arise, and no parent is younger. The first row is a root."""
    ranked = number_rows(rows, time_buckets(F.col("anchor")), [F.col("anchor"), F.col("rid")], "_rank")
    n = F.col("_rank") - 1
    pick = F.when((uniform(F.col("rid"), *parts, "root") >= root_fraction) & (n > 0), below(n, F.col("rid"), *parts) + 1)
    above = ranked.select(F.col("_rank").alias("_pick"), F.col("rid").alias("parent"))
    return ranked.withColumn("_pick", pick).join(above, "_pick", "left").drop("_pick", "_rank")


def as_of_count(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows(rid, anchor) with n_before: how many of others(anchor) are not later. Days and minutes are the buckets."""
    both = rows.select("rid", "anchor", F.lit(0).cast("long").alias("_one")).unionByName(others.select(F.lit(None).cast("long").alias("rid"), "anchor", F.lit(1).cast("long").alias("_one")))
    order = [F.col("anchor"), F.col("_one").desc(), F.col("rid")]
    counted = running_total(both.filter("anchor is not null"), F.col("_one"), time_buckets(F.col("anchor")), order, "n_before").filter("_one = 0").select("rid", "n_before")
    return rows.join(counted, "rid", "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)))


def earlier_pick(children: DataFrame, parents: DataFrame, null_rate: float, *parts) -> DataFrame:
    """children(rid, anchor) with pick: the rid of one of parents(rid, anchor) that are not later, null if there is none."""
    counted = as_of_count(children, parents)
    ranked = number_rows(parents.filter("anchor is not null"), time_buckets(F.col("anchor")), [F.col("anchor"), F.col("rid")], "_rank").select(F.col("rid").alias("pick"), "_rank")
    rank = F.when((F.col("n_before") > 0) & (uniform(F.col("rid"), *parts, "null") >= null_rate), below(F.col("n_before"), F.col("rid"), *parts) + 1)
    return counted.withColumn("_rank", rank).join(ranked, "_rank", "left").drop("_rank", "n_before")


def sort_anchors(rows: DataFrame) -> DataFrame:
    """rows(rid, anchor) with the anchors that aren't null in ascending order over the rows that have one."""
    some = rows.filter("anchor is not null")
    by_row = number_rows(some.select("rid"), row_buckets(F.col("rid")), [F.col("rid")], "_place")
    by_time = number_rows(some.select("anchor", F.col("rid").alias("_tie")), time_buckets(F.col("anchor")), [F.col("anchor"), F.col("_tie")], "_place").drop("_tie")
    return by_row.join(by_time, "_place").drop("_place").unionByName(rows.filter("anchor is null").select("rid", "anchor"))
