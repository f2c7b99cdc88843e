"""Prints one JSON line with the seconds that headline queries take over BENCH_SF_DIR on local[BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomspark import catalogue
from loomspark.operators.validate import summary, validate
from loomspark.queries.flows import OBSERVATORY, observatory
from loomspark.sinks import files
from loomspark.sources.ddl import parse_ddl
from loomspark.storage import new_path

HEADLINE = ("validate_report", "validate_fk_orphans", "validate_fk_composite", "validate_child_before_parent", "fk_uniform", "fk_zipfian", "fk_allocation", "junction_unique", "coherence_floor", "coherence_anchor_rewrite", "coherence_lifecycle", "hierarchy_forest", "deferred_fk_backfill", "gen_timestamp", "gen_text", "rate_limit_replay", "stats_clicks_by_target", "stats_unique_sessions", "sink_sql_inserts")
#: Of the generated schema: about 490,000 rows in all, as the published figure has.
SCALE = 160


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    spark = builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = catalogue.queries()
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    began = time.time()
    schema, generator = parse_ddl(OBSERVATORY), observatory(spark, SCALE)
    tables = generator.run()
    report = summary(validate(tables, schema)).agg(F.sum("violations").alias("violations"), F.sum("constraints_checked").alias("checked")).first()
    files.write_sql(generator.numbered(), schema, generator.plan.order, new_path(spark, "sql"))
    took["generate_validate_write_sql"] = round(time.time() - began, 3)
    rows = sum(df.count() for df in tables.values())
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "generated_rows": rows, "violations": report["violations"], "constraints_checked": report["checked"]}))


if __name__ == "__main__":
    main()
