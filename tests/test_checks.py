"""CHECKs: what is read from them, systems of comparisons, and generated rows that satisfy both."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest

from loomspark.operators.generate import generate
from loomspark.operators.validate import validate
from loomspark.plans.checks import make_check, tokens_of, within
from loomspark.plans.config import Config
from loomspark.plans.differences import ORIGIN, systems
from loomspark.plans.model import DomainExhausted, bounds, filled
from loomspark.sources.ddl import parse_ddl

TABLE = parse_ddl('CREATE TABLE t (a INT, b INT, Amount NUMERIC(8,2), d DATE, e DATE, s TIMESTAMP, k TEXT, ok BOOLEAN, "Odd" INT)')["t"]


@pytest.mark.parametrize(
    "sql,facts,enough",
    [
        ("amount > 500", [("bound", "Amount", ">", Decimal(500))], True),
        ("500 < AMOUNT", [("bound", "Amount", ">", Decimal(500))], True),
        ("((a) >= 1) AND (a <= 9)", [("bound", "a", ">=", Decimal(1)), ("bound", "a", "<=", Decimal(9))], True),
        ("a BETWEEN -5 AND 5 AND b IN (1, 2)", [("range", "a", Decimal(-5), Decimal(5)), ("in", "b", [Decimal(1), Decimal(2)])], True),
        ("NOT (a < 3 OR b > a)", [("bound", "a", ">=", Decimal(3)), ("compare", "b", "<=", "a")], True),
        ("NOT a BETWEEN 3 AND 5", [], False),
        ("a IS NULL OR a > 3", [("bound", "a", ">", Decimal(3))], True),
        ("a IS NULL OR b > 3", [("bound", "b", ">", Decimal(3))], False),
        ("a IS NOT NULL", [("filled", "a")], True),
        ("a = 1 OR a = 2 OR a IN (5)", [("in", "a", [Decimal(1), Decimal(2), Decimal(5)])], True),
        ("a < 3 OR a > 7", [], False),
        ("a BETWEEN 1 AND 3 OR a BETWEEN 7 AND 9", [("bound", "a", ">=", Decimal(1)), ("bound", "a", "<=", Decimal(9))], False),
        ("2 * a - 4 > b * 0", [("bound", "a", ">", Decimal(2))], True),
        ("-a > 3", [("bound", "a", "<", Decimal(-3))], True),
        ("b - a >= 3", [("compare", "b", ">=", "a", Decimal(3))], True),
        ("a + 2 < b - 1", [("compare", "a", "<", "b", Decimal(-3))], True),
        ("a = b", [("compare", "a", ">=", "b"), ("compare", "a", "<=", "b")], True),
        ("a <> b", [], False),
        ("a + b < 7", [], False),
        ("a % 3 = 0 AND a > 1", [("bound", "a", ">", Decimal(1))], False),
        ("f(a) > 3 AND b < 4", [("bound", "b", "<", Decimal(4))], False),
        ("d >= DATE '2024-01-01'", [("bound", "d", ">=", dt.date(2024, 1, 1))], True),
        ("d >= '2024-01-01 12:00:00'", [("bound", "d", ">", dt.date(2024, 1, 1))], True),
        ("d + 3 <= e", [("compare", "d", "<=", "e", dt.timedelta(days=-3))], True),
        ("s < '2024-01-01'::timestamp with time zone", [], False),
        ("s < '2024-01-01'::timestamp", [("bound", "s", "<", dt.datetime(2024, 1, 1))], True),
        ("s - INTERVAL '2 hours' > d", [("compare", "s", ">", "d", dt.timedelta(hours=2))], True),
        ("k = 'it''s a > b' OR k IN ('x')", [("in", "k", ["it's a > b", "x"])], True),
        ("k = '2024-01-01'", [("in", "k", ["2024-01-01"])], True),
        ("(k)::text = ANY ((ARRAY['x'::text, 'y'])::text[])", [("in", "k", ["x", "y"])], True),
        ("k LIKE 'a%' AND ok", [("in", "ok", [True])], False),
        ("NOT ok", [("in", "ok", [False])], True),
        ("ok IS TRUE", [], False),
        ('"Odd" > 3', [("bound", "Odd", ">", Decimal(3))], True),
        ('"odd" > 3', [], False),
        ("t.a > t.b", [("compare", "a", ">", "b")], True),
        ("a > ", [], False),
    ],
)
def test_facts(sql, facts, enough):
    check = make_check(tokens_of(sql), TABLE)
    assert (check.facts, check.enough) == (facts, enough)


def test_facts_agree_with_spark(spark):
    """Where facts are enough, rows that satisfy them pass the CHECK as Spark evaluates it, nulls too; where a CHECK passes without
    alternatives, its facts hold."""
    rng = random.Random(11)
    tests = ["a > {n}", "a <= {n}", "b BETWEEN {n} AND {m}", "a IN ({n}, {m})", "a < b", "b - a >= {n}", "a IS NULL", "b IS NOT NULL", "a <> {n}", "a + b > {m}"]

    def body(depth: int) -> str:
        if not depth:
            return rng.choice(tests).format(n=rng.randrange(-3, 3), m=rng.randrange(-2, 5))
        return rng.choice(["({} AND {})", "({} OR {})", "NOT ({})"]).format(body(depth - 1), body(depth - 1))

    checks = [make_check(tokens_of(body(rng.randrange(4))), TABLE) for _ in range(150)]
    values = [None, *range(-4, 6)]
    rows = list(itertools.product(values, values))
    df = spark.createDataFrame(rows, "a int, b int")
    got = df.selectExpr("a", "b", *[f"coalesce({c.sql}, true) AS c{i}" for i, c in enumerate(checks)]).collect()
    compare = {">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, "=": lambda x, y: x == y}

    def holds(fact, row):
        if fact[0] == "filled":
            return row[fact[1]] is not None
        v = row[fact[1]]
        if fact[0] == "compare":
            w = row[fact[3]]
            return v is None or w is None or compare[fact[2]](v, w + (fact[4] if len(fact) > 4 else 0))
        return v is None or (v in fact[2] if fact[0] == "in" else fact[2] <= v <= fact[3] if fact[0] == "range" else compare[fact[2]](v, fact[3]))

    settled = 0
    for i, c in enumerate(checks):
        for r in got:
            if c.enough and all(holds(f, r) for f in c.facts):
                assert r[f"c{i}"], (c, r)
        settled += c.enough
    assert settled > 30


def test_sql_of_checks():
    check = make_check(tokens_of("""amount > 5 AND k <> 'amount , ( x )' AND "Odd" > T.A"""), TABLE)
    assert check.sql == "`Amount` > 5 AND k <> 'amount , ( x )' AND `Odd` > `a`" and check.columns == ["Amount", "k", "Odd", "a"]
    assert within(check, TABLE, "s[1]", ["Amount", "k"]) == "s[1].`Amount` > 5 AND s[1].`k` <> 'amount , ( x )' AND `Odd` > `a`"


def test_names_in_any_case():
    s = parse_ddl("CREATE TABLE Parents (ID INT, Code INT, PRIMARY KEY (id), UNIQUE (CODE)); CREATE TABLE kids (p INT REFERENCES parents (Id), FOREIGN KEY (P) REFERENCES PARENTS)")
    assert s["Parents"].key == ["ID"] and s["Parents"].lone == {"Code"}
    assert [(f.columns, f.table, f.to) for f in s["kids"].references] == [(["p"], "Parents", ["ID"])] * 2


def test_bounds_of_facts():
    t = parse_ddl("CREATE TABLE t (x NUMERIC(4,2) CHECK (x > 0 AND x < 1), y INT CHECK (y = 4), z INT CHECK (z IS NOT NULL))")["t"]
    assert bounds(t, t.row["x"]) == (Decimal("0.01"), Decimal("0.99"), None) and bounds(t, t.row["y"])[:2] == (4, 4)
    assert filled(t, "z") and not filled(t, "y")


def brute_intervals(edges, ends, n):
    """Feasible values of n columns by trying all."""
    rows = [r for r in itertools.product(*[range(lo, hi + 1) for lo, hi in ends]) if all(r[x] >= r[y] + w for x, y, w in edges)]
    return [(min(c), max(c)) for c in zip(*rows, strict=True)] if rows else None


def test_systems_against_all_rows():
    rng = random.Random(3)
    exhausted = 0
    for _ in range(120):
        n = rng.choice([2, 3, 4])
        ends = [(lo := rng.randrange(-4, 4), lo + rng.randrange(1, 8)) for _ in range(n)]
        edges = [(i, j, rng.randrange(-2, 4)) for i, j in itertools.permutations(range(n), 2) if rng.random() < 0.45]
        if not edges:
            continue
        names = "abcd"[:n]
        ddl = ", ".join(f"{c} INT CHECK ({c} BETWEEN {lo} AND {hi})" for c, (lo, hi) in zip(names, ends, strict=True)) + "".join(f", CHECK ({names[i]} >= {names[j]} + {w})" for i, j, w in edges)
        want = brute_intervals(edges, ends, n)
        if want is None:
            with pytest.raises(DomainExhausted):
                systems(parse_ddl(f"CREATE TABLE t ({ddl})")["t"], [], {})
            exhausted += 1
            continue
        for s in systems(parse_ddl(f"CREATE TABLE t ({ddl})")["t"], [], {}):
            for c in s.columns:
                assert s.interval(c) == want[names.index(c)]
    assert exhausted > 10


def test_steps_of_a_system():
    t = parse_ddl("CREATE TABLE t (a INT, x NUMERIC(6,2), b INT, CHECK (a < x), CHECK (x < b))")["t"]
    (s,) = systems(t, [], {})
    assert s.least["b", "a"] == 100 and s.columns[:2] != ["x", "a"] and s.least["x", "a"] == 1
    d = parse_ddl("CREATE TABLE t (d DATE, s TIMESTAMP, e DATE, CHECK (d < s), CHECK (s < e))")["t"]
    (s,) = systems(d, [], {})
    assert s.least["e", "d"] == 86400 and (ORIGIN, "e") not in s.least
    for cycle in ("CHECK (a < x), CHECK (x < b), CHECK (b < a + 1)", "CHECK (a > b), CHECK (b > a)"):
        with pytest.raises(DomainExhausted):
            systems(parse_ddl(f"CREATE TABLE t (a INT, x NUMERIC(6,2), b INT, {cycle})")["t"], [], {})


#: All rows satisfy all checks; columns without NOT NULL have nulls besides.
GENERATED = [
    ("lo INT NOT NULL, mid INT NOT NULL, hi INT NOT NULL, CHECK (lo < mid), CHECK (mid < hi)", 300),
    ("a INT NOT NULL, b INT NOT NULL, c INT NOT NULL, CHECK (c > b), CHECK (b > a)", 300),
    ("a DATE NOT NULL, b DATE NOT NULL CHECK (b <= '2025-06-01'), CHECK (b > a)", 500),
    ("a INT NOT NULL CHECK (a BETWEEN 1 AND 100), b INT NOT NULL CHECK (b BETWEEN 1 AND 100), CHECK (b > a)", 500),
    ("Amount INT NOT NULL CHECK (amount > 500), frames INT NOT NULL CHECK (Frames % 3 = 0)", 300),
    ("a NUMERIC(8,2) NOT NULL, b INT NOT NULL, c NUMERIC(9,4), f DOUBLE, CHECK (a < b AND b <= c - 2.5), CHECK (c < 50 OR c IS NULL), CHECK (f >= a)", 400),
    ("s TIMESTAMP NOT NULL, e TIMESTAMP, d DATE NOT NULL, CHECK (e >= s + INTERVAL '2 hours'), CHECK (NOT (d < s)), CHECK (e < '2025-03-01')", 400),
    ("a INT UNIQUE NOT NULL, b INT UNIQUE NOT NULL, c INT NOT NULL, CHECK (b > a + 3), CHECK (c BETWEEN a AND b), CHECK (a > id)", 400),
    ("k TEXT NOT NULL CHECK (k IN ('x', 'y')), a INT CHECK (a IS NOT NULL), b INT NOT NULL, CHECK (k = 'x' OR b > a), CHECK (b % 2 = 0)", 300),
    ("q INT NOT NULL CHECK (q IN (1, 5, 9) AND q > 3), r INT NOT NULL, CHECK (r >= q), CHECK (r <> q)", 300),
    ("x SMALLINT NOT NULL CHECK (x > 32700), y SMALLINT NOT NULL, z NUMERIC(3,2) NOT NULL, w NUMERIC(3,2) NOT NULL, CHECK (y > x), CHECK (z < w)", 200),
    ("a INT NOT NULL, b INT NOT NULL, c INT NOT NULL, CHECK (b > a), CHECK (a + b + c > 200), CHECK (c <> b)", 200),
]


@pytest.mark.parametrize("columns,rows", GENERATED)
def test_generated_rows_pass(spark, columns, rows):
    s = parse_ddl(f"CREATE TABLE t (id INT PRIMARY KEY, {columns});")
    made = generate(spark, s, {"t": rows}, Config(null_rate=0.2))
    assert validate(made, s).filter("violations > 0 OR severity = 'unverifiable'").collect() == []
    seen = made["t"].toPandas()
    assert len(seen) == rows and all(seen[c.name].nunique() > 1 for c in s["t"].row)


def test_checks_on_keys_only_are_named(spark):
    with pytest.warns(UserWarning, match="may not hold"):
        generate(spark, parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, u INT UNIQUE, CHECK (u + id > 3));"), {"t": 5})
    with pytest.raises(DomainExhausted, match="not all values"):
        generate(spark, parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, b INT NOT NULL CHECK (b < 20), CHECK (b > id));"), {"t": 50})


def test_anchors_of_a_hierarchy_rise_with_rows(spark):
    s = parse_ddl("CREATE TABLE staff (id INT PRIMARY KEY, boss INT REFERENCES staff(id), created_at TIMESTAMP, updated_at TIMESTAMP);")
    rows = generate(spark, s, {"staff": 200}, Config(null_rate=0.2))["staff"].orderBy("id").collect()
    times = [r["created_at"] for r in rows if r["created_at"]]
    assert times == sorted(times) and 100 < len(times) < 200
    assert all(r["updated_at"] is None or r["created_at"] is None or r["updated_at"] >= r["created_at"] for r in rows)


@pytest.mark.parametrize("values", ["'PENDING', 'SHIPPED', 'CANCELLED'", "'Pending', 'Shipped', 'Cancelled'"])
def test_status_gates_in_any_case(spark, values):
    s = parse_ddl(f"CREATE TABLE o (id INT PRIMARY KEY, status TEXT NOT NULL CHECK (status IN ({values})), created_at TIMESTAMP NOT NULL, shipped_at TIMESTAMP, cancelled_at TIMESTAMP);")
    rows = generate(spark, s, {"o": 200})["o"].collect()
    assert all((r["shipped_at"] is not None) == (r["status"].lower() == "shipped") and (r["cancelled_at"] is not None) == (r["status"].lower() == "cancelled") for r in rows)
