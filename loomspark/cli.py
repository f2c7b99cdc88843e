"""Command line: python -m loomspark.cli --ddl schema.sql --rows 100 --format csv --out folder.

Exit codes: 0 done, 1 an error, 2 done but with violations (the output is still written).
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.generate import Generator
from .operators.validate import summary, validate
from .plans.config import Config, apply_overrides, load
from .plans.graph import plan_generation
from .plans.model import SchemaError
from .plans.rows import ConfigError, integer_plan, parse_rows
from .sinks import database, files
from .sources.database import read_catalogue, redact
from .sources.ddl import parse_ddl
from .storage import scratch

URL_VARIABLES = ("DATABASE_URL", "POSTGRES_URL")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspark", description="Generates data for a relational schema.")
    p.add_argument("--ddl")
    p.add_argument("--from-db", action="store_true")
    p.add_argument("--db-url")
    p.add_argument("--rows", help="a number for all tables, or table=number,table=LOW..HIGH/parent")
    p.add_argument("--config")
    p.add_argument("--no-config", action="store_true")
    p.add_argument("--seed", type=int)
    p.add_argument("--format", choices=("csv", "sql", "db"), default="csv")
    p.add_argument("--out", default="out")
    p.add_argument("--dialect", default="postgres")
    for rate in ("null-rate", "fk-null-rate", "deferred-fk-null-rate", "root-fraction"):
        p.add_argument(f"--{rate}", type=float)
    p.add_argument("--as-of", type=dt.date.fromisoformat)
    p.add_argument("--fanout", choices=("uniform", "zipfian"))
    p.add_argument("--no-coherence", action="store_true")
    p.add_argument("--pools", action="append")
    p.add_argument("--preview", action="store_true")
    return p


def row_specs(text: str | None, config: Config, schema, order: list[str]) -> dict:
    """Flags win over the config's rows."""
    specs = dict(config.rows)
    if text and "=" in text:
        specs |= {t.strip(): parse_rows(v) for t, v in (x.split("=", 1) for x in text.split(","))}
    elif text:
        specs |= integer_plan(schema, order, parse_rows(text))
    if unknown := set(specs) - set(schema):
        raise ConfigError(f"row counts for unknown tables: {', '.join(sorted(unknown))}")
    return specs


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        path = a.config or ("datagen.toml" if Path("datagen.toml").exists() and not a.no_config else None)
        config = load(path) if path and not a.no_config else Config()
        config = config.with_flags(seed=a.seed, as_of=a.as_of, null_rate=a.null_rate, fk_null_rate=a.fk_null_rate, deferred_fk_null_rate=a.deferred_fk_null_rate, root_fraction=a.root_fraction, fanout=a.fanout, coherence=False if a.no_coherence else None, pools=tuple(a.pools) if a.pools else None)
        spark = spark or SparkSession.builder.appName("loomspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        url = a.db_url or next((os.environ[v] for v in URL_VARIABLES if os.environ.get(v)), None)
        if bool(a.ddl) == a.from_db:
            raise ConfigError("give either --ddl or --from-db")
        if (a.from_db or a.format == "db") and not url:
            raise ConfigError(f"a database URL is needed: --db-url or {' or '.join(URL_VARIABLES)}")
        with scratch(spark):  # all is written or shown when it ends
            schema = read_catalogue(spark, url) if a.from_db else parse_ddl(Path(a.ddl).read_text())
            apply_overrides(schema, config.columns)
            plan = plan_generation(schema)
            made = Generator(spark, schema, row_specs(a.rows, config, schema, plan.order), config)
            tables = made.run()
            found = validate(tables, schema)
            summary(found).orderBy("table").show(1000, False)
            bad = not found.filter((F.col("severity") == "error") & (F.col("violations") > 0)).isEmpty()
            if a.preview:
                for t in plan.order:
                    print(t)
                    files.preview(made.numbered()[t], ["_rid"]).drop("_rid").show(10, False)
            elif a.format == "csv":
                files.write_csv(made.numbered(), plan.order, a.out, "_rid")
            elif a.format == "sql":
                files.write_sql(made.numbered(), schema, plan.order, a.out)
            else:
                late: dict[str, list[str]] = {}
                for name, fk in plan.deferred:
                    late.setdefault(name, []).extend(fk.columns)
                database.load(tables, plan.order, url, deferred=late, keys={t: schema[t].key for t in late})
    except (SchemaError, OSError, PySparkException) as e:
        print(f"error: {redact(str(e))}", file=sys.stderr)
        return 1
    return 2 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
