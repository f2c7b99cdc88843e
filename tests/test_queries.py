"""Each query against its SQL in DuckDB."""

import decimal
import os
from pathlib import Path

import duckdb
import pytest

from loomspark import catalogue

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return c


def plain(v):
    return repr(v) if isinstance(v, float) else str(v.normalize()) if isinstance(v, decimal.Decimal) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    df = catalogue.queries()[name](spark, str(SF))
    found = db.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    assert ours == theirs


def test_every_query_has_sql_or_a_reason():
    assert set(catalogue.queries()) - set(SQL) == set()


def test_generated_report_has_no_violations(spark):
    rows = catalogue.queries()["generated_report"](spark, str(SF)).collect()
    assert len(rows) == 15 and all(r["violations"] == 0 and r["warnings"] == 0 for r in rows)
