"""CSV and SQL text, written by tasks in row order."""

from __future__ import annotations

import io
import json
import zipfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import clean_events
from ..plans.model import Schema

ROWS_A_STATEMENT = 500
PART = 256 << 20


def write_csv(tables: dict[str, DataFrame], order: list[str], folder: str, row: str | None = None) -> list[str]:
    """A CSV file for each table in the order of its row number (None: as its rows come): one header, CRLF line ends, nothing where a value is null.
    A file is a folder of parts whose manifest says which byte each starts at: one after another they are the same bytes however
    the rows were partitioned."""
    paths = []
    for name in order:
        df = tables[name]
        columns = [c for c in df.columns if c != row]
        place = F.col(f"`{row}`").cast("long") if row else F.monotonically_increasing_id() + 1
        lines = df.select(place.alias("_place"), csv_line(df.select(*[f"`{c}`" for c in columns])).alias("value"))
        cells = ['"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in columns]
        head = df.sparkSession.createDataFrame([(0, ",".join(cells))], "_place long, value string")
        paths.append(f"{folder}/{name}")
        write_lines(head.unionByName(lines), ["_place"], paths[-1], "\r\n")
    return paths


def write_lines(lines: DataFrame, order: list[str], path: str, separator: str = "\n") -> None:
    """lines(value) in order, as parts of about PART bytes in a folder and a manifest (file, start, length) beside it, which is written last: what has
    one is whole. A first pass over lengths says how many parts there are; rows are dealt to them by ranges of the order, so no task has more. Only
    the first part begins as the whole does, with a header if there is one."""
    spark = lines.sparkSession
    n = -(-lines.agg(F.coalesce(F.sum(F.octet_length("value") + len(separator)), F.lit(0))).first()[0] // PART) or 1
    lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select("value").write.option("lineSep", separator).text(path)
    parts = sorted((r["path"].rpartition("/")[2], r["length"]) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())  # a row a task
    starts = [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    manifest = spark.createDataFrame([(i, json.dumps({"file": f, "start": s, "length": k})) for i, ((f, k), s) in enumerate(zip(parts, starts, strict=True))], "i long, value string")
    manifest.coalesce(1).sortWithinPartitions("i").select("value").write.text(f"{path}.manifest")


def write_script(numbered: dict[str, DataFrame], schema: Schema, order: list[str], path: str) -> None:
    """One SQL script of all tables, parents first, as one transaction; a folder of parts and a manifest, as write_lines() makes them.
    numbered has the row number in _rid."""
    spark = next(iter(numbered.values())).sparkSession
    lines = spark.createDataFrame([(-1, 0, "BEGIN;"), (len(order), 0, "COMMIT;")], "_table int, _place long, value string")
    for i, name in enumerate(order):
        dense = numbered[name].select("_rid", *[f"`{c.name}`" for c in schema[name].row])
        lines = lines.unionByName(insert_statements(dense, name, "_rid").select(F.lit(i).alias("_table"), F.col("batch").alias("_place"), F.col("statement").alias("value")))
    write_lines(lines, ["_table", "_place"], path)


def csv_line(df: DataFrame) -> Column:
    """A row as a line of CSV: quoted where a value has a comma, a quote or a line end."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        text = F.when(c, "True").otherwise("False") if isinstance(f.dataType, T.BooleanType) else plain(c, f.dataType)
        quoted = F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
        return F.coalesce(F.when(c.isNotNull(), quoted), F.lit(""))

    return F.concat_ws(",", *[cell(f) for f in df.schema])


def plain(c: Column, kind: T.DataType) -> Column:
    """A value as text, without exponents."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.regexp_replace(c.cast("decimal(30,10)").cast("string"), r"0+$", "")
        return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)
    return c.cast("string")


def literal(c: Column, kind: T.DataType) -> Column:
    """A value as an SQL literal."""
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "TRUE").otherwise("FALSE")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("'"))
    elif isinstance(kind, T.NumericType):
        text = plain(c, kind)
    else:
        text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.isNull(), "NULL").otherwise(text)


def insert_statements(df: DataFrame, table: str, row: str, rows: int = ROWS_A_STATEMENT) -> DataFrame:
    """(batch, statement): INSERTs of that many rows each, in the order of the row number, which starts at 1."""
    fields = [f for f in df.schema if f.name != row]
    values = F.concat(F.lit("("), F.concat_ws(", ", *[literal(F.col(f"`{f.name}`"), f.dataType) for f in fields]), F.lit(")"))
    numbered = df.select(F.floor((F.col(row) - 1) / rows).cast("long").alias("batch"), F.col(row).alias("_row"), values.alias("_values"))
    grouped = numbered.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_row", "_values"))).alias("_rows"))
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    head = f"INSERT INTO {quote(table)} ({', '.join(quote(f.name) for f in fields)}) VALUES\n"
    return grouped.select("batch", F.concat(F.lit(head), F.array_join(F.transform("_rows", lambda r: r["_values"]), ",\n"), F.lit(";")).alias("statement"))


def write_sql(numbered: dict[str, DataFrame], schema: Schema, order: list[str], folder: str) -> list[str]:
    """A folder of statements for each table; folders' names give the order. numbered has the row number in _rid. The whole is one
    transaction if the files are read in order: 00-begin holds BEGIN and the last one COMMIT."""
    spark = next(iter(numbered.values())).sparkSession
    paths = [f"{folder}/00-begin"]
    spark.createDataFrame([("BEGIN;",)], "value string").coalesce(1).write.text(paths[0])

    def write(name: str, path: str) -> None:
        dense = numbered[name].select("_rid", *[f"`{c.name}`" for c in schema[name].row])
        insert_statements(dense, name, "_rid").sort("batch").select(F.col("statement").alias("value")).write.text(path)

    named = [(name, f"{folder}/{i:02}-{name}") for i, name in enumerate(order, 1)]
    with ThreadPoolExecutor(4) as pool:  # folders don't wait for each other
        list(pool.map(lambda x: write(*x), named))
    paths += [path for _, path in named]
    paths.append(f"{folder}/{len(order) + 1:02}-commit")
    spark.createDataFrame([("COMMIT;",)], "value string").coalesce(1).write.text(paths[-1])
    return paths


def preview(df: DataFrame, order: list[str], n: int = 10, width: int = 24) -> DataFrame:
    """The first n rows as text, cut to width characters."""
    first = df.orderBy(*order).limit(n)

    def cut(f: T.StructField) -> Column:
        text = plain(F.col(f"`{f.name}`"), f.dataType)
        return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text).alias(f.name)

    return first.select(*[cut(f) for f in first.schema])


def json_rows(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """(place, row): the first n rows as JSON."""
    first = df.orderBy(*order).limit(n)
    place = F.row_number().over(Window.orderBy(*order)).cast("long")
    return first.select(place.alias("place"), F.to_json(F.struct(*first.columns)).alias("row"))


def append_events(df: DataFrame, path: str) -> None:
    """Appends the events that are page views or clicks, cut and completed as readers of the log expect; others are left out."""
    clean_events(df).write.mode("append").json(path)


def zipped_csv(tables: dict[str, DataFrame], order: dict[str, list[str]], rows: int = 1000) -> bytes:
    """A ZIP of CSV files with the first rows of each table, for previews: rows is a bound, so it fits the driver."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, columns in order.items():
            first = tables[name].orderBy(*columns).limit(rows)
            lines = [r["line"] for r in first.select(*columns, csv_line(first).alias("line")).orderBy(*columns).collect()]
            z.writestr(f"{name}.csv", "".join(f"{x}\r\n" for x in [",".join(first.columns), *lines]))
    return out.getvalue()


def payload(tables: dict[str, DataFrame], order: dict[str, list[str]], findings: DataFrame, seed: int, rows: int = 10) -> str:
    """JSON with the order of tables, their row counts, their first rows and what validation found."""
    found = findings.agg(F.count("*").alias("checked"), F.sum("violations").alias("violations")).first()
    first = {t: [json.loads(r["row"]) for r in json_rows(tables[t], c, rows).orderBy("place").collect()] for t, c in order.items()}
    return json.dumps({"seed": seed, "order": list(order), "counts": {t: tables[t].count() for t in order}, "rows": first, "validation": {"checked": found["checked"], "violations": found["violations"]}})
