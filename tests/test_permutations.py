"""Keyed permutations, and the keys that are made with them."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions.permute import MOST, Permutation
from loomspark.operators import keys as K
from loomspark.plans.model import DomainExhausted


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000, 1009, 4099])
def test_small_permutations_are_bijections(spark, n):
    p = Permutation(n, 1, "t")
    rows = spark.range(n).select("id", p.of(F.col("id")).alias("j")).withColumn("back", p.back(F.col("j"))).collect()
    assert sorted(r["j"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)
    if n >= 97:
        assert sum(r["j"] == r["id"] for r in rows) < 10  # some stay by chance


@pytest.mark.parametrize("n", [10**6 + 3, 2**32 + 15, 10**11 + 3, 2**40, 2**40 - 87, MOST])
def test_large_permutations_by_sampling(spark, n):
    """No two of a sample fall together, all are in range, inverses lead back, Spark agrees with the driver, and results spread."""
    p, rng = Permutation(n, 7, "big"), random.Random(n)
    ids = sorted({*range(200), *range(n - 200, n), *(rng.randrange(n) for _ in range(3000))})
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select("i", p.of(F.col("i")).alias("j"), p.back(F.col("i")).alias("k"))
    rows = rows.withColumn("back", p.back(F.col("j"))).withColumn("on", p.of(F.col("k"))).collect()
    assert len({r["j"] for r in rows}) == len(rows) == len(ids) and all(0 <= r["j"] < n and r["back"] == r["i"] == r["on"] for r in rows)
    for r in rows[:50]:
        j = p.step(r["i"])
        while j >= n:
            j = p.step(j)
        assert j == r["j"]
    low = sum(r["j"] < n // 2 for r in rows) / len(rows)
    assert abs(low - 0.5) < 0.05


def test_pairs_outside_are_few():
    rng = random.Random(1)
    for bits in (10, 20, 30, 40):
        for n in (rng.randrange(2 ** (bits - 1), 2**bits) for _ in range(5)):
            p = Permutation(n, "x")
            assert n <= p.a * p.b and p.a * p.b - n == len(p._on) <= 64


def test_permuted_keys_have_no_window_or_sort(spark):
    rows = spark.range(1, 1001).select(F.col("id").alias("rid"))
    plan = rows.select(K.ranked(1000, 1).of(F.col("rid") - 1), K.permuted_pick(2000, 1000, F.col("rid"), 2), *K.cells([50, 40], 1000, F.col("rid"), 3))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Sort", "Exchange", "Join"))


def test_allocations(spark):
    """Every parent has as many children as it is given, children are numbered without gaps, and no child's row is sorted or shuffled."""
    k = lambda rid: F.pmod(rid * 7, F.lit(4))
    made, total = K.allocate(spark, 1000, k, 1, "a")
    rows = made.collect()
    assert total == len(rows) == sum(i * 7 % 4 for i in range(1, 1001)) and sorted(r["rid"] for r in rows) == list(range(1, total + 1))
    per: dict = {}
    for r in rows:
        per.setdefault(r["pick"], []).append(r["place"])
    assert {p: sorted(v) for p, v in per.items()} == {i: list(range(1, i * 7 % 4 + 1)) for i in range(1, 1001) if i * 7 % 4}
    assert [r["pick"] for r in sorted(rows, key=lambda r: r["rid"])] != sorted(r["pick"] for r in rows)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Sort", "Exchange", "Join"))
    assert K.allocate(spark, 0, k, 1)[1] == 0 and K.allocate(spark, 5, lambda _: F.lit(0), 1)[0].count() == 0


def test_cells_of_many_combinations(spark):
    sizes = [10**7, 10**8, 10**9]
    rows = spark.range(1, 2001).select(*[c.alias(f"c{i}") for i, c in enumerate(K.cells(sizes, 2000, F.col("id"), 5))]).collect()
    assert len(set(rows)) == 2000 and all(1 <= v <= s for r in rows for v, s in zip(r, sizes, strict=True))
    with pytest.raises(DomainExhausted):
        K.cells([3, 4], 13, F.col("id"))
