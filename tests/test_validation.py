"""Uniqueness, foreign keys and chronology by one grouping, against loops over rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import validate as V
from loomspark.sources.ddl import parse_ddl

DDL = """
CREATE TABLE p (a INT, b TEXT, u NUMERIC(6,2) UNIQUE, created_at {parent}, PRIMARY KEY (a, b));
CREATE TABLE q (id BIGINT PRIMARY KEY, code INT UNIQUE, created_at TIMESTAMP);
CREATE TABLE c (id INT PRIMARY KEY, a INT, b TEXT, q SMALLINT REFERENCES q(id), other INT REFERENCES q(code), up INT REFERENCES c(id), created_at TIMESTAMP, updated_at TIMESTAMP, FOREIGN KEY (a, b) REFERENCES p (a, b), UNIQUE (a, q));
"""
START = dt.datetime(2024, 1, 1)


def tables(rng, n, parent):
    at = lambda: rng.choice([None, START + dt.timedelta(hours=rng.randrange(200))])
    some = lambda k: rng.choice([None, *range(k)])
    p = [(some(5), rng.choice([None, "x", "y", "x,y"]), rng.choice([None, 1.5, 2.5, 3.25, 7.0]), at()) for _ in range(n // 3)]
    if parent == "DATE":
        p = [(*r[:3], r[3].date() if r[3] else None) for r in p]
    q = [(i if rng.random() < 0.9 else rng.choice([None, 0]), some(9), at()) for i in range(n // 4)]
    c = [(i if rng.random() < 0.9 else rng.choice([None, 1]), some(6), rng.choice([None, "x", "y", "z"]), some(n // 3), some(12), None if i < 5 else rng.randrange(i), at(), at()) for i in range(n)]
    return {"p": p, "q": q, "c": c}


TYPES = {"p": "a int, b string, u double, created_at {}", "q": "id long, code int, created_at timestamp_ntz", "c": "id int, a int, b string, q short, other long, up int, created_at timestamp_ntz, updated_at timestamp_ntz"}


def expected(schema, rows):
    out = {}
    place = {t: {c.name: i for i, c in enumerate(schema[t].row)} for t in schema}
    get = lambda t, r, columns: tuple(r[place[t][c]] for c in columns)
    for t, table in schema.items():
        for columns, kind in [(table.key, "primary_key"), *(([c], "unique") for c in table.lone), *((g, "unique") for g in table.groups)]:
            keys = [k for r in rows[t] if None not in (k := get(t, r, columns))]
            out[t, kind, ",".join(columns)] = len(keys) - len(set(keys)) + (len(rows[t]) - len(keys) if kind == "primary_key" else 0)
        for fk in table.references:
            there = {get(fk.table, r, fk.to) for r in rows[fk.table]}
            out[t, "foreign_key", ",".join(fk.columns)] = sum(None not in (k := get(t, r, fk.columns)) and k not in there for r in rows[t])
            if fk.table != t:
                tops: dict = {}
                for r in rows[fk.table]:
                    if (v := r[place[fk.table]["created_at"]]) is not None:
                        k = get(fk.table, r, fk.to)
                        tops[k] = max(v, tops.get(k, v))
                n = 0
                for r in rows[t]:
                    own, top = r[place[t]["created_at"]], tops.get(get(t, r, fk.columns))
                    if own is not None and top is not None and None not in get(t, r, fk.columns):
                        n += own.date() < top if not isinstance(top, dt.datetime) else own < top
                out[t, "coherence", f"created_at before {fk.table}"] = out.get((t, "coherence", f"created_at before {fk.table}"), 0) + n
    return out


@pytest.mark.parametrize("seed,n,parent", [(1, 60, "TIMESTAMP"), (2, 200, "DATE"), (3, 9, "TIMESTAMP")])
def test_against_loops(spark, seed, n, parent):
    schema, rows = parse_ddl(DDL.format(parent=parent)), tables(random.Random(seed), n, parent)
    frames = {t: spark.createDataFrame(r, TYPES[t].format({"DATE": "date", "TIMESTAMP": "timestamp_ntz"}[parent])) for t, r in rows.items()}
    got: dict = {}
    for r in V.validate(frames, schema).collect():
        if r["kind"] in ("primary_key", "unique", "foreign_key") or r["name"] in ("created_at before p", "created_at before q"):
            got[r["table"], r["kind"], r["name"]] = got.get((r["table"], r["kind"], r["name"]), 0) + r["violations"]
    assert got == expected(schema, rows)
    later = [r["violations"] for r in V.validate(frames, schema).filter("name = 'updated_at before created_at'").collect()]
    assert later == [sum(r[6] is not None and r[7] is not None and r[7] < r[6] for r in rows["c"])]


def test_samples_name_rows(spark):
    schema = parse_ddl("CREATE TABLE p (id INT PRIMARY KEY, code TEXT UNIQUE, created_at TIMESTAMP); CREATE TABLE c (id INT PRIMARY KEY, p INT REFERENCES p(id), created_at TIMESTAMP);")
    p = spark.createDataFrame([(1, "a", START), (2, "b", START), (3, "a", None)], "id int, code string, created_at timestamp_ntz")
    c = spark.createDataFrame([(10, 1, START), (11, 9, START), (12, 2, START - dt.timedelta(days=1))], "id int, p int, created_at timestamp_ntz")
    found = {(r["table"], r["kind"], r["name"]): (r["violations"], r["sample"]) for r in V.validate({"p": p, "c": c}, schema, samples=True).filter("violations > 0").collect()}
    assert found == {("p", "unique", "code"): (1, "a: rows 1 and 3"), ("c", "foreign_key", "p"): (1, "9"), ("c", "coherence", "created_at before p"): (1, "2: row 12")}


def test_one_scan_and_one_shuffle(spark):
    """The stream reads each table once, and its grouping is one exchange."""
    schema = parse_ddl(DDL.format(parent="TIMESTAMP"))
    frames = {t: spark.range(3).selectExpr(*[f"cast(null as {c.dataType.simpleString()}) as {c.name}" for c in table.row]) for t, table in schema.items()}
    sets = V._key_sets(schema, {t: set() for t in schema})
    plan = V.key_stream(frames, schema, sets).groupBy("g", "key").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 3 and plan.count("Exchange") == 1 and "Join" not in plan


def test_a_hot_parent_is_counted_before_it_is_shuffled(spark):
    schema = parse_ddl("CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (id INT PRIMARY KEY, p INT REFERENCES p(id));")
    rows = spark.range(200_000, numPartitions=8).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.lit(1)).alias("p"))
    found = {r["name"]: r["violations"] for r in V.validate({"p": spark.createDataFrame([(7,)], "id int"), "c": rows}, schema).filter("kind = 'foreign_key'").collect()}
    assert found == {"p": 133_333}
