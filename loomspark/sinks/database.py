"""Loading several tables into a database in one transaction.

Spark's JDBC writer commits each partition on its own, so rows go to staging tables first, which have the columns of their
targets. When all are there, the driver publishes them in one transaction: parents first, keys that close a cycle of references
as an update at its end, rows whose key the database already has left out where that is asked for, by the database itself (MERGE).
A job that fails leaves no row in any target, and staging tables go in any case. A partition that was committed twice, by a
task whose success was lost, counts once, as rows carry their number in the job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.database import Connection, jdbc_options

BATCH = 1000
_ROW = "LOAD_ROW"


#: Databases to which Spark's writer can't give a text that is null; a column that says so goes beside it until all rows are staged.
_NO_NULL_TEXTS = ("Apache Derby",)


def _texts(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]


def _staged(rows: DataFrame, options: dict[str, str], name: str, texts: list[str]) -> None:
    numbered = rows.withColumns({f"LOAD_NULL_{i}": F.col(f"`{c}`").isNull().cast("short") for i, c in enumerate(texts)} | {_ROW: F.monotonically_increasing_id()})
    numbered = numbered.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in texts})
    numbered.write.format("jdbc").options(**options, dbtable=name, batchsize=str(BATCH)).mode("append").save()


def load(tables: dict[str, DataFrame], order: list[str], url: str, ignore: dict[str, list[str]] | None = None, deferred: dict[str, list[str]] | None = None, keys: dict[str, list[str]] | None = None) -> dict[str, int]:
    """How many rows each table got. The tables must exist, and no other run may be staging the same names. ignore: by table, the key on
    which rows that the table has are left out, and of rows that share one the first is taken. deferred: by table, columns that are filled
    after all rows are there; such a table's primary key is in keys."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    ignore, deferred, keys, options = ignore or {}, deferred or {}, keys or {}, jdbc_options(url)
    run = uuid.uuid4().hex[:8].upper()
    stages = {name: f"LOAD_{run}_{i}" for i, name in enumerate(order)}
    counts: dict[str, int] = {}
    with Connection(spark, options) as db:
        real = {name: db.columns(name) for name in order}  # by the database's own spelling
        apart = db.product() in _NO_NULL_TEXTS
        texts = {name: _texts(tables[name]) if apart else [] for name in order}
        made: list[str] = []
        try:
            for name in order:
                db.run(f"CREATE TABLE {stages[name]} AS SELECT {db.listed(real[name].values())} FROM {db.table(name)} WITH NO DATA")
                made.append(stages[name])
                db.run(f"ALTER TABLE {stages[name]} ADD COLUMN {_ROW} BIGINT")
                for i in range(len(texts[name])):
                    db.run(f"ALTER TABLE {stages[name]} ADD COLUMN LOAD_NULL_{i} SMALLINT")
            db.commit()
            for name in order:
                _staged(tables[name], options, stages[name], texts[name])
                for i, c in enumerate(texts[name]):
                    db.run(f"UPDATE {stages[name]} SET {db.quote(real[name][c.lower()])} = NULL WHERE LOAD_NULL_{i} = 1")
            for name in order:
                columns = [real[name][c.lower()] for c in tables[name].columns]
                later = {real[name][c.lower()] for c in deferred.get(name, ())}
                now = [c for c in columns if c not in later]
                once = f"(SELECT DISTINCT {db.listed(columns)}, {_ROW} FROM {stages[name]})"
                if name in ignore:
                    on = [real[name][c.lower()] for c in ignore[name]]
                    first = f"(SELECT {db.listed(on)}, MIN({_ROW}) AS {_ROW} FROM {once} x GROUP BY {db.listed(on)})"
                    same = " AND ".join(f"s.{db.quote(c)} = f.{db.quote(c)}" for c in on)
                    db.run(f"DELETE FROM {stages[name]} WHERE {_ROW} NOT IN (SELECT s.{_ROW} FROM {once} s JOIN {first} f ON s.{_ROW} = f.{_ROW} AND {same})")
                    there = " AND ".join(f"t.{db.quote(c)} = s.{db.quote(c)}" for c in on)
                    counts[name] = db.run(f"MERGE INTO {db.table(name)} t USING {stages[name]} s ON {there} WHEN NOT MATCHED THEN INSERT ({db.listed(now)}) VALUES ({', '.join(f's.{db.quote(c)}' for c in now)})")
                else:
                    counts[name] = db.run(f"INSERT INTO {db.table(name)} ({db.listed(now)}) SELECT {db.listed(now)} FROM {once} s")
            for name, columns in deferred.items():
                on = " AND ".join(f"t.{db.quote(real[name][c.lower()])} = s.{db.quote(real[name][c.lower()])}" for c in keys[name])
                put = ", ".join(f"{db.quote(real[name][c.lower()])} = s.{db.quote(real[name][c.lower()])}" for c in columns)
                db.run(f"MERGE INTO {db.table(name)} t USING {stages[name]} s ON {on} WHEN MATCHED THEN UPDATE SET {put}")
            db.commit()
        except BaseException:
            db.rollback()
            raise
        finally:
            for stage in made:
                db.run(f"DROP TABLE {stage}")
            db.commit()
    return counts
