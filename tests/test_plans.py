"""DDL, dependency order, row counts, configuration, catalogue rows."""

import datetime as dt
from decimal import Decimal

import pytest

from loomspark.plans import config as cfg
from loomspark.plans.graph import plan_generation
from loomspark.plans.model import SchemaError, bounds, hint_of
from loomspark.plans.rows import ConfigError, Fanout, capped_plan, check_caps, check_fanout, integer_plan, parse_rows
from loomspark.queries.synthesis import SMALL
from loomspark.sources.database import assemble, jdbc_options, normalise_url, plain_check, redact
from loomspark.sources.ddl import parse_ddl

DDL = """
CREATE TABLE public.parents (id SERIAL PRIMARY KEY, code CHAR(4) UNIQUE, name VARCHAR(10) NOT NULL DEFAULT 'it''s', created_at TIMESTAMP WITH TIME ZONE DEFAULT now());
CREATE TABLE IF NOT EXISTS kids ( -- a comment
  a INT, b NUMERIC(6,2) CHECK (b BETWEEN 1 AND 5.5), c DATE CHECK (c >= DATE '2024-01-01'), d DATE, e INT CHECK (e > -5), f INT CHECK (f IN (1, 2)), g JSONB,
  CONSTRAINT later CHECK (d > c), CONSTRAINT pk PRIMARY KEY (a, b), FOREIGN KEY (a) REFERENCES parents, UNIQUE (c, d), CHECK (a + e < 7));
ALTER TABLE kids ADD CONSTRAINT q UNIQUE (d), ADD COLUMN h BOOLEAN; ALTER TABLE nothing ADD CHECK (a > 1);
"""


def test_ddl():
    s = parse_ddl(DDL)
    p, k = s["parents"], s["kids"]
    assert p.key == ["id"] and p.lone == {"code"} and p.row["code"].metadata["length"] == 4 and not p.row["name"].nullable and p.row["created_at"].metadata["sql"] == "TIMESTAMP"
    assert k.key == ["a", "b"] and k.groups == [["c", "d"]] and k.lone == {"d"} and k.row["f"].metadata["domain"] == [1, 2] and k.row["g"].metadata["sql"] == "UNKNOWN" and k.row["h"].dataType.simpleString() == "boolean"
    assert [(f.columns, f.table, f.to) for f in k.references] == [(["a"], "parents", ["id"])] and not k.row["a"].nullable
    assert {c.form for c in k.checks if c.form} == {("range", "b", Decimal(1), Decimal("5.5")), ("bound", "c", ">=", dt.date(2024, 1, 1)), ("bound", "e", ">", Decimal(-5)), ("compare", "d", ">", "c")}
    assert [c.sql for c in k.checks if not c.form] == ["a + e < 7"]
    assert bounds(k, k.row["e"])[0] == -4


def test_hints():
    assert hint_of("user_email", "t") == "email" and hint_of("name", "users") == "full_name" and hint_of("name", "products") is None and hint_of("unit_price", "t") == "money"


def test_order_and_cycles():
    s = parse_ddl("CREATE TABLE staff (id INT PRIMARY KEY, dep INT NOT NULL REFERENCES deps(id)); CREATE TABLE deps (id INT PRIMARY KEY, head INT REFERENCES staff(id));")
    plan = plan_generation(s)
    assert plan.order == ["deps", "staff"] and [(t, fk.columns) for t, fk in plan.deferred] == [("deps", ["head"])]
    with pytest.raises(SchemaError):
        plan_generation(parse_ddl("CREATE TABLE a (id INT PRIMARY KEY, b INT NOT NULL REFERENCES b(id)); CREATE TABLE b (id INT PRIMARY KEY, a INT NOT NULL REFERENCES a(id));"))
    with pytest.raises(SchemaError):
        plan_generation(parse_ddl("CREATE TABLE a (id INT PRIMARY KEY, b INT REFERENCES nowhere(id));"))


def test_row_counts():
    assert parse_rows("12") == 12 and parse_rows("5..20 per users") == Fanout(5, 20, "users") == parse_rows("5..20/users")
    for bad in ("-1", "x", "5..2 per users", "5.. per users"):
        with pytest.raises(ConfigError):
            parse_rows(bad)
    s = parse_ddl(SMALL)
    order = plan_generation(s).order
    assert list(integer_plan(s, order, 1).values()) == [1, 1, 1, 3, 3, 9]
    assert sum(capped_plan(integer_plan(s, order, 100)).values()) <= 1000


@pytest.mark.parametrize("table,parent", [("users", "users"), ("users", "nowhere"), ("users", "orders"), ("order_items", "employees"), ("employees", "employees"), ("orders", "users")])
def test_fanout_errors(table, parent):
    s = parse_ddl(SMALL)
    with pytest.raises(ConfigError):
        check_fanout(s, plan_generation(s), table, Fanout(1, 2, parent), set())


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[project]\nseed = 7\nas_of = 2025-01-01\n[rows]\nusers = 10\norders = "2..4 per users"\n[generation]\nnull_rate = 0.2\nfanout = "uniform"\n[columns."orders.status"]\nvalues = ["a", "b"]\nweights = [3, 1]\n')
    c = cfg.load(f)
    assert c.seed == 7 and c.rows["orders"] == Fanout(2, 4, "users") and c.columns["orders.status"].weights == (3, 1) and c.with_flags(seed=9, null_rate=None).seed == 9
    for bad in ("[project]\nseed = true", "[nope]\n", "[generation]\nnull_rate = 2", '[generation]\nfanout = "odd"', '[columns."x"]\nmin = 1', '[columns."a.b"]\nweights = [1]', "[generation]\nodd = 1", "[rows]\na = true", "["):
        f.write_text(bad)
        with pytest.raises(ConfigError):
            cfg.load(f)


def test_overrides():
    ddl = "CREATE TABLE t (id INT PRIMARY KEY, n INT CHECK (n > 3), s TEXT CHECK (s IN ('a', 'b')));"
    s = cfg.apply_overrides(parse_ddl(ddl), {"t.n": cfg.Override(max=10), "t.s": cfg.Override(values=("a",))})
    assert bounds(s["t"], s["t"].row["n"])[:2] == (4, 10) and s["t"].row["s"].metadata["domain"] == ["a"]
    for name, o in (("t.n", cfg.Override(max=1)), ("t.s", cfg.Override(values=("c",))), ("t.id", cfg.Override(min=1)), ("x.y", cfg.Override(min=1)), ("t.y", cfg.Override(min=1)), ("t.s", cfg.Override(min=1)), ("t.n", cfg.Override(values=("q",)))):
        with pytest.raises(ConfigError):
            cfg.apply_overrides(parse_ddl(ddl), {name: o})


def test_catalogue_gives_the_same_model():
    rows = [dict(table_name="t", column_name=n, data_type=d, character_maximum_length=m, numeric_precision=p, numeric_scale=sc, is_nullable=y, column_default=None) for n, d, m, p, sc, y in (("id", "integer", None, 32, 0, "NO"), ("s", "character varying", 9, None, None, "YES"), ("v", "numeric", None, 6, 2, "YES"), ("up", "integer", None, 32, 0, "YES"))]
    cons = [dict(table_name="t", name=n, contype=k, definition=d, cols=c, ref_table=r, ref_cols=rc) for n, k, d, c, r, rc in (("a", "p", "", ["id"], None, None), ("b", "c", "CHECK (((s)::text = ANY ((ARRAY['x'::character varying, 'y'::character varying])::text[])))", ["s"], None, None), ("c", "c", "CHECK (((v >= (1)::numeric) AND (v <= 5.5)))", ["v"], None, None), ("d", "f", "", ["up"], "t", ["id"]))]
    got = assemble(["t"], rows, cons)
    want = parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR(9) CHECK (s IN ('x', 'y')), v NUMERIC(6,2) CHECK (v BETWEEN 1 AND 5.5), up INT REFERENCES t(id));")
    assert got["t"].row == want["t"].row and got["t"].key == want["t"].key and got["t"].references == want["t"].references and got["t"].checks == want["t"].checks
    assert plain_check("CHECK ((price > (0)::numeric))") == "price > 0"


def test_urls():
    assert normalise_url("postgres://a") == "postgresql://a" and redact("x postgresql://u:secret@h/d y") == "x postgresql://u:***@h/d y"
    assert jdbc_options("postgresql+psycopg://u:p%40@h:99/d?sslmode=require") == {"url": "jdbc:postgresql://h:99/d?sslmode=require", "driver": "org.postgresql.Driver", "user": "u", "password": "p@"}


def test_caps():
    check_caps(parse_ddl(SMALL), SMALL, 1000)
    for args in ((parse_ddl(SMALL), "x" * 60_000), (parse_ddl(SMALL), "", 1001), (parse_ddl("".join(f"CREATE TABLE t{i} (id INT);" for i in range(16))),), (parse_ddl(""),)):
        with pytest.raises(ConfigError):
            check_caps(*args)
