"""Generated data: every constraint re-derived, determinism, errors, corrupted data, command line, sinks, streams."""

import collections
import csv
import datetime as dt
import io
import itertools
import json
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark import cli
from loomspark.operators import keys as K
from loomspark.operators import stats
from loomspark.operators.budget import BudgetExceeded, within
from loomspark.operators.coherence import RANKS, TERMINAL
from loomspark.operators.generate import Generator, generate
from loomspark.operators.ranking import row_buckets, running_total
from loomspark.operators.validate import validate
from loomspark.plans.config import Config, Override
from loomspark.plans.model import DomainExhausted, SchemaError
from loomspark.plans.rows import parse_rows
from loomspark.sinks import files
from loomspark.sources import pools
from loomspark.sources.ddl import parse_ddl
from loomspark.storage import compiled, new_path
from loomspark.streaming import events

SCHEMA = """
CREATE TABLE orgs (id UUID PRIMARY KEY, name VARCHAR(80) NOT NULL, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP);
CREATE TABLE people (id SERIAL PRIMARY KEY, org_id UUID NOT NULL REFERENCES orgs(id), first_name VARCHAR(20), gender VARCHAR(10), manager_id INT REFERENCES people(id), score INT CHECK (score % 3 = 0), low INT NOT NULL CHECK (low >= 0), high INT NOT NULL, created_at TIMESTAMP NOT NULL, last_login TIMESTAMP, CHECK (high > low));
CREATE TABLE goods (id SERIAL PRIMARY KEY, org_id UUID NOT NULL REFERENCES orgs(id), sku VARCHAR(8) NOT NULL, product_name VARCHAR(40), category TEXT, price NUMERIC(6,2) NOT NULL CHECK (price > 0), UNIQUE (org_id, sku));
CREATE TABLE orders (id BIGSERIAL PRIMARY KEY, person_id INT NOT NULL REFERENCES people(id), status VARCHAR(10) CHECK (status IN ('pending', 'paid', 'shipped', 'delivered', 'cancelled')), created_at TIMESTAMP NOT NULL, shipped_at TIMESTAMP, delivered_at TIMESTAMP, cancelled_at TIMESTAMP);
CREATE TABLE items (order_id BIGINT REFERENCES orders(id), good_id INT REFERENCES goods(id), quantity INT NOT NULL CHECK (quantity > 0), PRIMARY KEY (order_id, good_id));
CREATE TABLE badges (person_id INT PRIMARY KEY REFERENCES people(id), label TEXT);
"""
ROWS = {"orgs": 4, "people": 40, "goods": 30, "orders": "1..4 per people", "items": "1..3 per orders", "badges": 25}


def make(spark, seed=42, **settings):
    return generate(spark, parse_ddl(SCHEMA), {t: parse_rows(n) for t, n in ROWS.items()}, Config(seed=seed, null_rate=0.2, **settings))


@pytest.fixture(scope="module")
def made(spark):
    return {t: df.cache() for t, df in make(spark).items()}


def test_no_violations(made):
    bad = validate(made, parse_ddl(SCHEMA)).filter("violations > 0").collect()
    assert bad == []


def test_constraints_by_hand(made):
    p, o, i, g = (made[t].toPandas() for t in ("people", "orders", "items", "goods"))
    assert (p["high"] > p["low"]).all() and p["score"].dropna().mod(3).eq(0).all()
    assert o.groupby("person_id").size().reindex(p["id"], fill_value=0).between(1, 4).all()
    assert i.groupby("order_id").size().between(1, 3).all() and not i.duplicated(["order_id", "good_id"]).any()
    assert not g.duplicated(["org_id", "sku"]).any() and g["sku"].str.len().le(8).all() and g["price"].gt(0).all()
    assert made["badges"].select("person_id").distinct().count() == 25


def test_hierarchy_is_a_forest(made):
    rows = made["people"].select("id", "manager_id", "created_at").toPandas().set_index("id")
    for k in rows.index:
        seen = set()
        while not (m := rows["manager_id"][k]) != m and m is not None:
            assert k not in seen and rows["created_at"][int(m)] <= rows["created_at"][k]
            seen.add(k)
            k = int(m)


def test_status_gate(made):
    for r in made["orders"].collect():
        for c in ("shipped_at", "delivered_at", "cancelled_at"):
            stage = c[:-3]
            if r["status"] in TERMINAL:
                assert (r[c] is not None) == (stage == r["status"])
            elif r["status"] is not None:
                assert (r[c] is not None) == (stage not in TERMINAL and RANKS[stage] <= RANKS[r["status"]])
        times = [r[c] for c in ("created_at", "shipped_at", "delivered_at") if r[c]]
        assert times == sorted(times)


def test_pools_go_together(made):
    from loomspark.sources.pools import load_pools

    person = {r["first_name"]: r["gender"] for p in load_pools() if p.name == "person" for r in p.records}
    assert all(person[r["first_name"]] == r["gender"] for r in made["people"].collect() if r["first_name"] and r["gender"])
    price = {r["product_name"]: (r["price_min"], r["price_max"]) for p in load_pools() if p.name == "products" for r in p.records}
    assert all(price[r["product_name"]][0] <= r["price"] <= price[r["product_name"]][1] for r in made["goods"].collect() if r["product_name"])


@pytest.mark.parametrize("limit", [32 << 20, 1000])
def test_large_pools_are_joined(spark, tmp_path, monkeypatch, limit):
    """A pool of 300,000 records from files: columns come from one record, a unique one never twice; broadcast or not."""
    monkeypatch.setattr(pools, "BROADCAST", limit)
    spark.range(300_000).selectExpr("concat('city', id) AS city", "concat('state', id % 1000) AS state", "if(id % 10 = 0, null, concat('land', id % 7)) AS country").repartition(3).write.parquet(f"{tmp_path}/places.parquet")
    (tmp_path / "geo.json").write_text(json.dumps({"name": "geo", "match": ["city", "state", "country"], "records": f"{tmp_path}/places.parquet"}))
    s = parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, city TEXT UNIQUE NOT NULL, state TEXT NOT NULL, country TEXT); CREATE TABLE u (id INT PRIMARY KEY, city TEXT NOT NULL, state TEXT NOT NULL);")
    made = generate(spark, s, {"t": 5000, "u": 5000}, Config(pools=(str(tmp_path),), null_rate=0.0))
    t, u = made["t"].collect(), made["u"].collect()
    for r in (*t, *u):
        i = int(r["city"][4:])
        assert r["state"] == f"state{i % 1000}"
    assert len({r["city"] for r in t}) == 5000 and len({r["city"] for r in u}) > 4900
    assert all(r["country"] == f"land{int(r['city'][4:]) % 7}" for r in t if int(r["city"][4:]) % 10) and validate(made, s).filter("violations > 0").collect() == []


def test_same_seed_same_rows_however_partitioned(spark, made):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = make(spark)
    spark.conf.set("spark.sql.shuffle.partitions", old)
    for t in ("people", "items"):
        assert sorted(map(str, again[t].collect())) == sorted(map(str, made[t].collect()))
    assert sorted(map(str, make(spark, 43)["orders"].collect())) != sorted(map(str, made["orders"].collect()))


@pytest.mark.parametrize(
    "ddl,rows",
    [
        ("CREATE TABLE t (id INT PRIMARY KEY, c VARCHAR(2) UNIQUE);", 100_000),
        ("CREATE TABLE t (id INT PRIMARY KEY, n NUMERIC(4,2) CHECK (n >= 500));", 3),
        ("CREATE TABLE t (id INT PRIMARY KEY, a INT NOT NULL CHECK (a > 900), b INT NOT NULL, CHECK (a + b < 3));", 5),
        ("CREATE TABLE t (id INT PRIMARY KEY, a INT CHECK (a > 9), CHECK (a < 5));", 5),
    ],
)
def test_exhausted_domains(spark, ddl, rows):
    with pytest.raises(DomainExhausted):
        generate(spark, parse_ddl(ddl), {"t": rows})


def test_small_schemas(spark):
    ddl = """CREATE TABLE t (id INT PRIMARY KEY, n NUMERIC(4,2), a INT CHECK (a BETWEEN 5 AND 5), x INT CHECK (x < 0), y INT CHECK (y > 2.5), d DATE CHECK (d >= '2030-01-01'), up INT, CHECK (id > up));
    CREATE TABLE deps (id INT PRIMARY KEY, head INT REFERENCES staff(id), created_at TIMESTAMP NOT NULL); CREATE TABLE staff (id INT PRIMARY KEY, dep INT NOT NULL REFERENCES deps(id), created_at TIMESTAMP NOT NULL);"""
    s = parse_ddl(ddl)
    got = generate(spark, s, {"t": 50, "deps": 10, "staff": 30})
    assert validate(got, s).filter("violations > 0").collect() == []
    rows = got["t"].collect()
    assert {r["a"] for r in rows} <= {5, None} and all(r["x"] is None or r["x"] < 0 for r in rows) and all(r["y"] is None or r["y"] >= 3 for r in rows) and all(r["d"] is None or r["d"] >= dt.date(2030, 1, 1) for r in rows)
    joined = got["deps"].alias("d").join(got["staff"].alias("s"), F.col("d.head") == F.col("s.id")).filter("s.created_at > d.created_at")
    assert joined.count() == 0


def test_weights_and_missing_counts(spark):
    s = parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, k TEXT NOT NULL CHECK (k IN ('a', 'b')));")
    n = generate(spark, s, {"t": 2000}, Config(columns={"t.k": Override(values=("a", "b"), weights=(9, 1))}))["t"].filter("k = 'a'").count()
    assert abs(n / 2000 - 0.9) < 0.05
    with pytest.raises(SchemaError):
        generate(spark, s, {})


def test_validator_reports_corrupted_data(spark):
    s = parse_ddl("CREATE TABLE p (id INT PRIMARY KEY, up INT REFERENCES p(id)); CREATE TABLE t (id INT PRIMARY KEY, k VARCHAR(3) CHECK (k IN ('a', 'b')), n INT NOT NULL CHECK (n BETWEEN 1 AND 9), d DATE, u UUID, v NUMERIC(4,2) UNIQUE, p INT REFERENCES p(id));")
    p = spark.createDataFrame([(1, 2), (2, 1), (3, None), (4, 2)], "id int, up int")
    t = spark.createDataFrame([(1, "a", "5", "2024-01-01", "x", 1.0, 1), (1, "long", "12", "soon", None, 1.0, 9), (None, None, None, None, None, 123.456, None), (4, "b", "1.5", None, None, None, 3)], "id int, k string, n string, d string, u string, v double, p int")
    got = {(r["kind"], r["name"]): r["violations"] for r in validate({"p": p, "t": t}, s).filter("violations > 0").collect()}
    assert got == {("type", "k"): 1, ("enum", "k"): 1, ("not_null", "id"): 1, ("not_null", "n"): 1, ("type", "n"): 1, ("check", "n BETWEEN 1 AND 9"): 1, ("type", "d"): 1, ("type", "u"): 1, ("type", "v"): 1, ("primary_key", "id"): 2, ("unique", "v"): 1, ("foreign_key", "p"): 1, ("coherence", "up cycle"): 3}


def test_checks_in_the_database_s_own_words(spark):
    """Pattern operators are read as Spark's; a check that Spark can't read is reported and doesn't stop anything."""
    s = parse_ddl(r"CREATE TABLE t (id INT PRIMARY KEY, a TEXT CHECK (a ~ '^[a-z]+\d$'), b TEXT CHECK (b ~* '^X'), c TEXT CHECK (c !~~ '%no%'), d TEXT CHECK (d ~~* 'y%'), e INT CHECK (my_own_function(e) > 3), f INT CHECK (e @> f));")
    rows = spark.createDataFrame([(1, "abc1", "xx", "yes", "Yes", 1, 1), (2, "ABC", "ox", "a no", "no", 1, 1), (3, None, None, None, None, None, None)], "id int, a string, b string, c string, d string, e int, f int")
    got = {r["name"]: (r["violations"], r["severity"]) for r in validate({"t": rows}, s).filter("kind = 'check'").collect()}
    assert len(got) == 6 and all(got[k.sql] == ((1, "error") if k.columns[0] in "abcd" else (0, "unverifiable")) for k in s["t"].checks)
    with pytest.warns(UserWarning, match="can't evaluate"):
        assert generate(spark, parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, e INT CHECK (my_own_function(e) > 3));"), {"t": 5})["t"].count() == 5


def test_zipf_shares(spark):
    children = spark.range(20_000).withColumnRenamed("id", "rid")
    got = sorted((r["count"] for r in K.zipf_pick(children, 100, 1, "z").groupBy("pick").count().collect()), reverse=True)
    exact = 1 / sum(r**-0.7 for r in range(1, 101))
    assert sum(got) == 20_000 and abs(got[0] / 20_000 - exact) < 0.01


def test_sinks(spark, made, tmp_path):
    rows = spark.createDataFrame([(1, "it's", True, 1.5e9, dt.datetime(2024, 1, 2, 3, 4, 5)), (2, None, False, None, None)], "_rid long, s string, b boolean, f double, t timestamp_ntz")
    (r,) = files.insert_statements(rows, "t", "_rid").collect()
    assert r["statement"] == 'INSERT INTO "t" ("s", "b", "f", "t") VALUES\n(\'it\'\'s\', TRUE, 1500000000.0, \'2024-01-02T03:04:05\'),\n(NULL, FALSE, NULL, NULL);'
    path = new_path(spark, "csv")
    files.write_csv({"t": rows.select("s", "b")}, ["t"], path)
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{path}/t").collect()), key=str) == sorted([("it's", "True"), (None, "False")], key=str)


def whole(path, separator):
    """A file's bytes by its manifest."""
    parts = [json.loads(x) for f in sorted(Path(f"{path}.manifest").glob("part-*")) for x in f.read_text().splitlines()]
    data = b"".join((Path(path) / p["file"]).read_bytes() for p in parts)
    assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:i]) for i in range(len(parts))] and sum(p["length"] for p in parts) == len(data)
    return data.decode()


def test_files_are_the_same_however_rows_are_partitioned(spark, tmp_path, monkeypatch):
    texts = ["plain", 'a "quote"', "comma, here", "two\r\nlines", None, "", "é"]
    values = [(i, texts[i % 7], i % 3 == 0, 1.5 * i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(1, 1201)]
    kind = '_rid long, "a, b" string, ok boolean, f double, at timestamp_ntz'.replace('"a, b"', "`a, b`")
    found = set()
    for n, size in ((1, 10**6), (3, 10**4), (8, 5000)):
        monkeypatch.setattr(files, "PART", size)
        df = spark.createDataFrame(values[::-1], kind).repartition(n)
        files.write_csv({"t": df}, ["t"], f"{tmp_path}/csv{n}", "_rid")
        found.add(whole(f"{tmp_path}/csv{n}/t", "\r\n"))
    (text,) = found
    rows = list(csv.reader(io.StringIO(text, newline="")))
    assert rows[0] == ["a, b", "ok", "f", "at"] and len(rows) == 1201
    assert rows[1:] == [[v[1] or "", str(v[2]), str(float(v[3])), str(v[4])] for v in values]


def test_one_script_of_all_tables(spark, made, tmp_path):
    schema = parse_ddl(SCHEMA)
    order, found = ["orgs", "people"], set()
    for n in (1, 5):
        numbered = {t: made[t].select(F.row_number().over(Window.orderBy(made[t]["id"])).alias("_rid"), "*").repartition(n) for t in order}
        files.write_script(numbered, schema, order, f"{tmp_path}/script{n}")
        found.add(whole(f"{tmp_path}/script{n}", "\n"))
    (text,) = found
    assert text.startswith("BEGIN;\nINSERT INTO \"orgs\"") and text.endswith(";\nCOMMIT;\n") and text.index('INTO "orgs"') < text.index('INTO "people"') and text.count("\n(") == 44


def test_events_are_taken_in_once(spark, tmp_path):
    """Batches of a log, one of them run again, against the batch report; lines that are no events are kept apart with a reason."""
    rng, lines = random.Random(4), []
    for i in range(400):
        event = {"event": rng.choice(["pageview", "click"]), "path": "/" * (i % 3), "target": rng.choice(["a", ""]), "session": rng.choice(["", "s1", "s2", f"x{i % 9}"]), "ts": f"2026-01-01T0{i % 4}:{i % 60:02}:00Z"}
        lines.append(json.dumps(event))
    lines[10:10] = ["not json", '{"event": "other"}', "[1, 2]", "", '{"path": "/"}']
    for i in range(4):
        (tmp_path / f"log{i}.jsonl").write_text("\n".join(lines[i::4]))
    log, out = f"file://{tmp_path}/*.jsonl", f"file://{tmp_path}/out"
    events.ingest_log(spark, log, out, f"file://{tmp_path}/state", 1)
    before = sorted(map(tuple, events.hourly_totals(spark, out).collect()))
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # the last batch has been written, but not been noted as done
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    events.ingest_log(spark, log, out, f"file://{tmp_path}/state", 1)
    assert sorted(map(tuple, events.hourly_totals(spark, out).collect())) == before
    rejected = {r["value"]: r["reason"] for r in spark.read.parquet(f"{out}/rejected").collect()}
    assert rejected == {"not json": "not JSON", '{"event": "other"}': "unknown event", "[1, 2]": rejected["[1, 2]"], '{"path": "/"}': "unknown event"}
    good = [json.loads(x) for x in lines if '"ts"' in x]
    want = collections.defaultdict(lambda: [0, 0, set()])
    for e in good:
        hour = want[dt.datetime.fromisoformat(e["ts"][:13] + ":00:00")]
        hour[e["event"] == "click"] += 1
        if e["event"] == "pageview" and e["session"]:
            hour[2].add(e["session"])
    assert before == sorted((h, v, c, len(s)) for h, (v, c, s) in want.items())
    assert spark.read.parquet(f"{out}/events").count() == 400


def test_command_line(spark, tmp_path, capsys):
    ddl = tmp_path / "s.sql"
    ddl.write_text("CREATE TABLE a (id INT PRIMARY KEY, s TEXT); CREATE TABLE b (id INT PRIMARY KEY, a INT REFERENCES a(id));")
    out = new_path(spark, "cli")
    shared = Path(new_path(spark, "x").removeprefix("file://")).parent
    before = set(shared.glob("*"))
    assert cli.main(["--ddl", str(ddl), "--rows", "5", "--no-config", "--format", "sql", "--out", out], spark) == 0
    assert {p.name.rsplit("-", 1)[0] for p in set(shared.glob("*")) - before} == {"cli"}  # intermediate tables are gone
    assert spark.read.text(f"{out}/01-a").count() > 5
    assert cli.main(["--ddl", str(ddl), "--rows", "a=3,b=1..2/a", "--no-config", "--preview"], spark) == 0
    assert cli.main(["--ddl", str(ddl), "--rows", "zzz=3", "--no-config"], spark) == 1
    assert cli.main(["--rows", "3", "--no-config"], spark) == 1


def test_limits_are_replayed_in_runs(spark):
    """Hits of a key are cut where the limiter has forgotten all; decisions are those of one pass."""
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(3000)), i) for i, k in enumerate(rng.choices([1, 2, 3, None], [80, 10, 5, 5], k=600))]
    got = {r["i"]: (r["allowed"], r["retry_after"]) for r in stats.replay_limits(spark.createDataFrame(rows, "k long, at double, i long"), "k", "at", "i", 2, 20.0).collect()}
    kept: dict = {}
    for k, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[i] == stats.decide(kept.setdefault(k, collections.deque()), at, 2, 20.0)


def test_running_totals_over_buckets(spark):
    rows = [(i, i % 7) for i in range(3000)] + [(70_000_000 + i, 1) for i in range(50)] + [(2**40, 5)]
    df = spark.createDataFrame(rows, "rid long, v long")
    got = {r["rid"]: r["t"] for r in running_total(df, F.col("v"), row_buckets(F.col("rid")), [F.col("rid")], "t").collect()}
    assert got == dict(zip([r[0] for r in rows], itertools.accumulate(r[1] for r in rows)))


def test_limiter_keeps_state_between_batches(spark):
    path = new_path(spark, "hits")
    for part in ([(1, 1, 0.0), (1, 2, 5.0), (2, 3, 5.0)], [(1, 4, 6.0), (1, 5, 61.0), (2, 6, 7.0)]):
        spark.createDataFrame(part, "key long, event_id long, at double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("key long, event_id long, at double").option("maxFilesPerTrigger", 1).parquet(path)
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in events.run_available(events.limited(stream, 2, 60.0), "limited").collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (True, 0), 4: (False, 55), 5: (True, 0), 6: (True, 0)}


def test_previews(spark, made):
    data = files.zipped_csv({"orgs": made["orgs"].select("name")}, {"orgs": ["name"]}, 2)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        lines = z.read("orgs.csv").decode().split("\r\n")
    assert lines[0] == "name" and len(lines) == 4
    found = json.loads(files.payload({"orgs": made["orgs"].select("name")}, {"orgs": ["name"]}, validate(made, parse_ddl(SCHEMA)), 42, 2))
    assert found["counts"] == {"orgs": 4} and len(found["rows"]["orgs"]) == 2 and found["validation"]["violations"] == 0


def test_budget(spark):
    assert within(spark, 60, lambda: spark.range(10).count()) == 10
    with pytest.raises(BudgetExceeded):
        within(spark, 0.5, lambda: spark.range(10**13).selectExpr("sum(hash(id))").collect())


def test_event_log(spark):
    path = new_path(spark, "log")
    lines = ['{"event": "pageview", "path": "", "session": "a", "ts": "2026-01-01T00:00:00Z"}', "not json", '{"event": "click", "target": "generate", "session": "b"}', '{"event": "other"}', '{"event": "pageview", "path": "/", "session": "b"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    report = stats.event_report(stats.read_events(spark, path))
    assert report["pageviews"].first()[0] == 2 and report["unique_sessions"].first()[0] == 2
    assert [tuple(r) for r in report["clicks"].collect()] == [("generate", 1)] and [tuple(r) for r in report["paths"].collect()] == [("/", 2)]


def test_children_are_made_in_many_tasks(spark):
    """Blocks of parents are a few bytes each; all children of a table were once made from one file, by one task."""
    made, total = K.allocate(spark, 20_000, lambda rid: F.pmod(rid, F.lit(3)), 1, "wide")
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == total == sum(i % 3 for i in range(1, 20_001)) and len(sizes) > 1 and max(sizes) < total * 0.6


def test_life_cycles_stay_small(spark):
    """What later times follow is computed once: expressions once doubled with each stage (648 draws in the plan of this table, 90 since)."""
    ddl = """CREATE TABLE o (id UUID PRIMARY KEY, p UUID NOT NULL REFERENCES p(id), status VARCHAR(10) NOT NULL CHECK (status IN ('draft', 'approved', 'completed', 'cancelled')),
        created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP, approved_at TIMESTAMP, completed_at TIMESTAMP, cancelled_at TIMESTAMP);
        CREATE TABLE p (id UUID PRIMARY KEY, created_at TIMESTAMP NOT NULL);"""
    g = Generator(spark, parse_ddl(ddl), {"p": 5, "o": 50}, Config())
    g.run()
    assert g.table("o")._jdf.queryExecution().optimizedPlan().toString().count("md5(") < 120


def test_compiled_leaves_the_session_as_it_was(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with compiled(spark):
        assert spark.conf.get(name) == "8000"
        with compiled(spark):
            pass
        assert spark.conf.get(name) == "8000"
    assert spark.conf.get(name) == before
