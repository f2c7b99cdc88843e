"""A live database: the Derby that Spark ships with, in memory, for the catalogue source and the transactional sink."""

import uuid

import pytest
from pyspark.sql import functions as F

from loomspark.operators.generate import generate
from loomspark.plans.graph import plan_generation
from loomspark.plans.model import SchemaError
from loomspark.sinks.database import load
from loomspark.sources.database import Connection, jdbc_options, read_catalogue
from loomspark.sources.ddl import parse_ddl

DDL = """
CREATE TABLE deps (id INT NOT NULL PRIMARY KEY, head INT, name VARCHAR(20) NOT NULL UNIQUE);
CREATE TABLE staff (id INT NOT NULL PRIMARY KEY, dep INT NOT NULL REFERENCES deps (id), boss INT REFERENCES staff (id), pay DECIMAL(8,2) CHECK (pay >= 10), born DATE, seen TIMESTAMP, ok BOOLEAN, lo INT, hi INT, CHECK (lo < hi), UNIQUE (dep, hi));
CREATE TABLE tasks (a INT NOT NULL, b INT NOT NULL, note VARCHAR(30), share DOUBLE, PRIMARY KEY (a, b), FOREIGN KEY (a) REFERENCES staff (id));
ALTER TABLE deps ADD CONSTRAINT lead FOREIGN KEY (head) REFERENCES staff (id);
"""


@pytest.fixture
def url(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    with Connection(spark, jdbc_options(url)) as db:
        for statement in DDL.split(";"):
            if statement.strip():
                db.run(statement)
        db.commit()
    return url


def rows(spark, url, table):
    return spark.read.format("jdbc").options(**jdbc_options(url), dbtable=table).load()


def names(spark, url):
    with Connection(spark, jdbc_options(url)) as db:
        return sorted(r["table_name"] for r in db.rows(db.meta.getTables(None, db.db.getSchema(), "%", None), "TABLE_NAME"))


def described(schema):
    return {
        t: (
            [(c.name, c.dataType, c.nullable, c.metadata["sql"], c.metadata.get("length")) for c in table.row],
            table.key, sorted(table.lone), sorted(table.groups), sorted((r.columns, r.table, r.to) for r in table.references), sorted(c.facts for c in table.checks),
        )
        for t, table in schema.items()
    }


def test_a_live_catalogue_equals_its_ddl(spark, url):
    assert described(read_catalogue(spark, url)) == described(parse_ddl(DDL))


def test_generated_tables_load_in_one_transaction(spark, url):
    schema = read_catalogue(spark, url)
    tables, plan = generate(spark, schema, {"deps": 5, "staff": 40, "tasks": 60}), plan_generation(schema)
    late: dict = {}
    for name, fk in plan.deferred:
        late.setdefault(name, []).extend(fk.columns)
    counts = load(tables, plan.order, url, deferred=late, keys={n: schema[n].key for n in late})
    assert counts == {"deps": 5, "staff": 40, "tasks": 60} and names(spark, url) == ["DEPS", "STAFF", "TASKS"]
    for name, df in tables.items():
        found = rows(spark, url, name)
        key = schema[name].key
        got = [tuple(map(str, r)) for r in found.select(*[F.col(c) for c in df.columns]).orderBy(*key).collect()]
        assert got == [tuple(map(str, r)) for r in df.orderBy(*key).collect()]


def test_a_task_that_fails_leaves_no_row(spark, url):
    deps = spark.createDataFrame([(1, None, "a"), (2, None, "b")], "id int, head int, name string")
    staff = spark.range(1, 2001, numPartitions=4).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") == 1999, F.raise_error("lost")).otherwise(F.lit(1)).cast("int").alias("dep"))
    with pytest.raises(Exception, match="lost"):
        load({"deps": deps, "staff": staff}, ["deps", "staff"], url)
    assert rows(spark, url, "deps").count() == rows(spark, url, "staff").count() == 0 and names(spark, url) == ["DEPS", "STAFF", "TASKS"]
    orphan = spark.createDataFrame([(1, 9)], "id int, dep int")  # the database's own constraint, after deps were published
    with pytest.raises(Exception, match="(?i)constraint"):
        load({"deps": deps, "staff": orphan}, ["deps", "staff"], url)
    assert rows(spark, url, "deps").count() == 0 and names(spark, url) == ["DEPS", "STAFF", "TASKS"]
    with pytest.raises(SchemaError):
        load({"nothing": deps}, ["nothing"], url)


def test_rows_that_the_table_has_are_ignored(spark, url):
    first = spark.createDataFrame([(1, None, "a"), (2, None, "b")], "id int, head int, name string")
    assert load({"deps": first}, ["deps"], url, ignore={"deps": ["name"]}) == {"deps": 2}
    more = spark.createDataFrame([(3, None, "b"), (4, None, "c"), (5, None, "c"), (6, None, "d")], "id int, head int, name string").coalesce(1)
    assert load({"deps": more}, ["deps"], url, ignore={"deps": ["name"]}) == {"deps": 2}
    assert sorted((r["ID"], r["NAME"]) for r in rows(spark, url, "deps").collect()) == [(1, "a"), (2, "b"), (4, "c"), (6, "d")]
    assert load({"deps": more.limit(0)}, ["deps"], url) == {"deps": 0}
