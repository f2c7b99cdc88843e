"""Independent validation of tables against a schema.

Findings are rows (table, kind, name, violations, severity). All row-local checks of a table, those of its chronology too, are
one aggregation over one scan. Uniqueness, foreign keys and chronology between tables are read off one stream of keys of all
tables: each row gives its own keys and those that it refers to, and one grouping by key, with partial counts, decides which keys repeat,
have children but no parent, or a child older than the parent. Only such keys are written, and only their rows are looked at
again. A null passes CHECK, enum, UNIQUE and foreign keys. A CHECK that Spark can't read is reported with the severity
unverifiable, and no violations.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import plan_generation
from ..plans.model import TIMED, WHOLE, Check, Reference, Schema, Table, Unique
from ..storage import compiled, materialise
from .coherence import anchor_of, later
from .hierarchy import unrooted


def type_violation(c: Column, column, actual: str) -> Column:
    """Whether a value isn't of the column's type; text stands for any type that it can be cast to."""
    if column.metadata["sql"] in ("NUMERIC", *WHOLE) and actual == column.dataType.simpleString():
        return F.lit(False)
    if column.metadata["sql"] == "VARCHAR" and column.metadata.get("length"):
        return F.length(c) > column.metadata.get("length")
    if column.metadata["sql"] == "NUMERIC":
        # what the type can't hold, or holds only when rounded
        as_type = c.try_cast(column.dataType)
        return c.isNotNull() & (as_type.isNull() | (c.try_cast("decimal(38,10)") != as_type.cast("decimal(38,10)")))
    if column.metadata["sql"] == "UUID":
        return c.isNotNull() & ~c.cast("string").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    if column.metadata["sql"] in WHOLE:
        kind = {"INTEGER": "int", "BIGINT": "bigint", "SMALLINT": "smallint"}[column.metadata["sql"]]
        return c.isNotNull() & (c.try_cast(kind).isNull() | (c.try_cast("decimal(38,10)") != c.try_cast(kind).cast("decimal(38,10)")))
    if column.metadata["sql"] in (*TIMED, "BOOLEAN", "FLOAT"):
        kind = {"DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "FLOAT": "double"}[column.metadata["sql"]]
        return c.isNotNull() & c.try_cast(kind).isNull() if actual == "string" else F.lit(False)
    return F.lit(False)


def readable(df: DataFrame, check: Check) -> bool:
    """Whether Spark can read a check over the columns of df."""
    try:
        return df.select(F.expr(check.sql).cast("boolean")).columns is not None
    except (ParseException, AnalysisException):
        return False


def row_checks(df: DataFrame, table: Table, deferred: set[str] = frozenset()) -> DataFrame:
    """(kind, name, violations) of not-null, type, enum and check rules, of keys without a value, and of times before the row's
    anchor: one scan."""
    kinds, rules = dict(df.dtypes), []
    declared = {c.name: c.dataType for c in table.row}
    # checks read values of the declared types; text that isn't of its type is null to them, and a violation of type

    def typed(c: str) -> Column:
        value = F.col(f"`{c}`")
        return (value.try_cast(declared[c]) if kinds[c] == "string" and c in declared else value).alias(c)

    df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_raw"), *[typed(c) for c in df.columns])
    for c in table.row:
        value = F.col("_raw").getField(c.name)
        rules.append(("not_null", c.name, value.isNull() if not c.nullable else F.lit(False)))
        rules.append(("type", c.name, F.coalesce(type_violation(value, c, kinds[c.name]), F.lit(False))))
        if c.metadata.get("domain") is not None:
            rules.append(("enum", c.name, value.isNotNull() & ~value.isin(*c.metadata.get("domain"))))
    for check in table.checks:
        if readable(df, check):
            rules.append(("check", check.sql, ~F.coalesce(F.expr(check.sql), F.lit(True))))
    if table.key:
        rules.append(("primary_key", ",".join(table.key), F.greatest(*[F.col("_raw").getField(c).isNull().cast("int") for c in table.key], F.lit(0)) > 0))
    if anchor := anchor_of(table):
        rules += [("coherence", f"{c} before {anchor}", F.col(f"`{c}`") < F.col(f"`{anchor}`")) for c in later(table, deferred)]
    counted = df.agg(*[F.count_if(rule).alias(f"_{i}") for i, (_, _, rule) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.col(f"_{i}").alias("violations")) for i, (k, n, _) in enumerate(rules)])
    return counted.select(F.inline(rows))


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, ref_columns: list[str]) -> DataFrame:
    """Rows of child whose key is no row of parent; a null in the key passes."""
    keys = parent.select(*[F.col(f"`{r}`").alias(f"_ref{i}") for i, r in enumerate(ref_columns)])
    on = [F.col(f"`{c}`") == F.col(f"_ref{i}") for i, c in enumerate(columns)]
    return child.dropna(subset=columns).join(keys, on, "left_anti")


def before_parent(child: DataFrame, columns: list[str], anchor: str, parent: DataFrame, ref_columns: list[str], parent_anchor: str) -> DataFrame:
    """Rows of child that are older than their parent; a date and a time are compared as dates."""
    keys = parent.select(*[F.col(f"`{r}`").alias(f"_ref{i}") for i, r in enumerate(ref_columns)], F.col(f"`{parent_anchor}`").alias("_anchor"))
    on = [F.col(f"`{c}`") == F.col(f"_ref{i}") for i, c in enumerate(columns)]
    own, theirs = F.col(f"`{anchor}`"), F.col("_anchor")
    if "date" in (dict(child.dtypes)[anchor], dict(keys.dtypes)["_anchor"]):
        own, theirs = F.to_date(own), F.to_date(theirs)
    return child.join(keys, on).filter(own < theirs)


@dataclass
class _Keys:
    """Columns of a table that are unique, or referred to; children: (table, reference, whether anchors are compared)."""

    table: str
    columns: tuple[str, ...]
    rules: list[Unique] = field(default_factory=list)
    children: list[tuple[str, Reference, bool]] = field(default_factory=list)


def _key_sets(schema: Schema, deferred: dict[str, set[str]]) -> list[_Keys]:
    found: dict[tuple, _Keys] = {}

    def of(table: str, columns: list[str]) -> _Keys:
        return found.setdefault((table, tuple(columns)), _Keys(table, tuple(columns)))

    for name, table in schema.items():
        for rule in table.of(Unique):
            of(name, rule.columns).rules.append(rule)
        for fk in table.references:
            compared = fk.table != name and not set(fk.columns) & deferred[name] and anchor_of(table) and anchor_of(schema[fk.table])
            of(fk.table, fk.to).children.append((name, fk, bool(compared)))
    return list(found.values())


def _text(df: DataFrame, column: str, other: str | None) -> Column:
    """A key's value as text that is the same for equal values; other: the type that it is compared with."""
    own = df.schema[column].dataType.simpleString()
    whole = ("tinyint", "smallint", "int", "bigint")
    if other is None or own == other or own in whole and other in whole or "string" in (own, other) and own not in whole and other not in whole:
        return F.col(f"`{column}`").cast("string")
    return F.coalesce(F.col(f"`{column}`").try_cast("decimal(38,10)").cast("string"), F.col(f"`{column}`").cast("string"))


def key_stream(tables: dict[str, DataFrame], schema: Schema, sets: list[_Keys], samples: bool = False) -> DataFrame:
    """(g, key, child, anchor, row): for each row of each table its keys in set g (child -1), and those that it refers to as the child of
    that number; nulls give none. row is its primary key, if samples are asked for. Each table is read once."""
    streams = None
    for name, df in tables.items():
        table, entries = schema[name], []
        anchor = anchor_of(table)
        at = F.col(f"`{anchor}`").try_cast("timestamp_ntz") if anchor else F.lit(None).cast("timestamp_ntz")
        row = F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in table.key]) if table.key and samples else F.lit(None).cast("string")

        def entry(g: int, child: int, columns: list[str], others: list[str | None], df=df, at=at, row=row) -> Column:
            some = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])
            key = F.array(*[_text(df, c, o) for c, o in zip(columns, others, strict=True)])
            return F.struct(F.lit(g).alias("g"), F.when(some, key).alias("key"), F.lit(child).alias("child"), at.alias("anchor"), row.alias("row"))

        for g, s in enumerate(sets):
            if s.table == name:
                mixed = [next((t for n, fk, _ in s.children if (t := tables[n].schema[fk.columns[j]].dataType.simpleString()) != df.schema[c].dataType.simpleString()), None) for j, c in enumerate(s.columns)]
                entries.append(entry(g, -1, list(s.columns), mixed))
            for i, (child, fk, _) in enumerate(s.children):
                if child == name:
                    entries.append(entry(g, i, fk.columns, [tables[s.table].schema[r].dataType.simpleString() for r in s.columns]))
        if entries:
            more = df.select(F.inline(F.array(*entries))).filter("key is not null")
            streams = more if streams is None else streams.unionByName(more)
    return streams


def _older(child: Column, parent: Column, dates: bool) -> Column:
    """A date and a time are compared as dates."""
    return F.coalesce(F.to_date(child) < F.to_date(parent) if dates else child < parent, F.lit(False))


def _key_findings(tables: dict[str, DataFrame], schema: Schema, deferred: dict[str, set[str]], samples: bool) -> list[tuple]:
    """(table, kind, name, violations, severity, sample) of uniqueness, foreign keys and chronology between tables."""
    sets = _key_sets(schema, deferred)
    if not sets:
        return []
    stream, most = key_stream(tables, schema, sets, samples), max(len(s.children) for s in sets)

    def dates(s: _Keys, i: int) -> bool:
        return "DATE" in (schema[n].row[anchor_of(schema[n])].metadata["sql"] for n in (s.table, s.children[i][0]))

    own = F.col("child") == -1
    parts = [F.count_if(own).alias("n"), F.max(F.when(own, F.col("anchor"))).alias("top")]  # of fixed size, so that partial counts are by hash
    for i in range(most):
        parts += [F.count_if(F.col("child") == i).alias(f"c{i}"), F.min(F.when(F.col("child") == i, F.col("anchor"))).alias(f"low{i}")]
    late = F.lit(False)
    for g, s in enumerate(sets):
        for i, (_, _, compared) in enumerate(s.children):
            if compared:
                late |= (F.col("g") == g) & _older(F.col(f"low{i}"), F.col("top"), dates(s, i))
    unique = F.col("g").isin([g for g, s in enumerate(sets) if s.rules])
    keys = stream.groupBy("g", "key").agg(*parts).withColumn("late", late).filter((unique & (F.col("n") > 1)) | (F.col("n") == 0) | F.col("late"))
    keys = materialise(keys, "keys")
    counts = {r["g"]: r for r in keys.groupBy("g").agg(
        F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("repeats"), F.min(F.when(F.col("n") > 1, F.col("key"))).alias("repeated"), F.max("late").alias("late"),
        *[F.sum(F.when(F.col("n") == 0, F.col(f"c{i}")).otherwise(0)).alias(f"c{i}") for i in range(most)], *[F.min(F.when((F.col("n") == 0) & (F.col(f"c{i}") > 0), F.col("key"))).alias(f"s{i}") for i in range(most)],
    ).collect()}  # a row for each set of keys
    older: dict[tuple[int, int], tuple] = {}
    if any(r["late"] for r in counts.values()):
        rows = stream.filter("child >= 0 and anchor is not null").join(keys.filter("late").select("g", "key", "top"), ["g", "key"])
        bad = reduce(lambda a, b: a | b, [(F.col("g") == g) & (F.col("child") == i) & _older(F.col("anchor"), F.col("top"), dates(s, i)) for g, s in enumerate(sets) for i, c in enumerate(s.children) if c[2]])
        older = {(r["g"], r["child"]): r for r in rows.filter(bad).groupBy("g", "child").agg(F.count("*").alias("n"), F.min(F.struct("key", "row")).alias("s")).collect()}
    ends: dict[int, tuple] = {}
    if samples:
        repeated = keys.filter("n > 1").groupBy("g").agg(F.min("key").alias("key"))
        ends = {r["g"]: r for r in stream.filter("child = -1").join(F.broadcast(repeated), ["g", "key"]).groupBy("g").agg(F.min("row").alias("first"), F.max("row").alias("last")).collect()}  # a key of each set
    out = []
    for g, s in enumerate(sets):
        r = counts.get(g)
        for rule in s.rules:
            twice = f"{', '.join(r['repeated'])}: rows {ends[g]['first']} and {ends[g]['last']}" if g in ends and r and r["repeated"] else None
            out.append((s.table, "primary_key" if rule.primary else "unique", ",".join(rule.columns), r["repeats"] if r else 0, "error", twice))
        for i, (child, fk, compared) in enumerate(s.children):
            out.append((child, "foreign_key", ",".join(fk.columns), r[f"c{i}"] if r else 0, "error", ", ".join(r[f"s{i}"]) if r and r[f"s{i}"] else None))
            if compared:
                found = older.get((g, i))
                out.append((child, "coherence", f"{anchor_of(schema[child])} before {s.table}", found["n"] if found else 0, "warning", f"{', '.join(found['s']['key'])}: row {found['s']['row']}" if found else None))
    return out


def validate(tables: dict[str, DataFrame], schema: Schema, samples: bool = False) -> DataFrame:
    """All findings, those without violations too. samples: also a sample of each violated key rule, its key with the first and the last row
    that has it, or a row's. They are counted once and read back."""
    spark = next(iter(tables.values())).sparkSession
    with compiled(spark):
        return materialise(_findings(spark, tables, schema, samples), "findings")


def _findings(spark: SparkSession, tables: dict[str, DataFrame], schema: Schema, samples: bool) -> DataFrame:
    plan, found = plan_generation(schema), None
    deferred = {name: plan.deferred_columns(name) for name in schema}
    for name, table in schema.items():
        local = row_checks(tables[name], table, deferred[name]).select(F.lit(name).alias("table"), "kind", "name", "violations", F.when(F.col("kind") == "coherence", "warning").otherwise("error").alias("severity"), F.lit(None).cast("string").alias("sample"))
        found = local if found is None else found.unionByName(local)
        for fk in table.references:
            if fk.table == name and len(fk.columns) == 1 and len(fk.to) == 1:
                cycles = unrooted(tables[name], fk.to[0], fk.columns[0]).agg(F.count("*").alias("violations"))
                found = found.unionByName(cycles.select(F.lit(name).alias("table"), F.lit("coherence").alias("kind"), F.lit(f"{fk.columns[0]} cycle").alias("name"), "violations", F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("sample")))
    rest = _key_findings(tables, schema, deferred, samples) + [(n, "check", c.sql, 0, "unverifiable", None) for n, t in schema.items() for c in t.checks if not readable(tables[n], c)]
    schema_of = "table string, kind string, name string, violations long, severity string, sample string"
    found = found.unionByName(spark.createDataFrame(rest, schema_of))
    # a primary key's missing values and its repeats are one finding; rules that are declared twice stay two
    keys = found.filter("kind = 'primary_key'").groupBy("table", "kind", "name", "severity").agg(F.sum("violations").alias("violations"), F.max("sample").alias("sample"))
    columns = ["table", "kind", "name", "violations", "severity", *(["sample"] if samples else [])]
    return found.filter("kind <> 'primary_key'").select(columns).unionByName(keys.select(columns))


def summary(findings: DataFrame) -> DataFrame:
    """By table: constraints checked, violations, and warnings apart from them."""
    error = F.col("severity") == "error"
    return findings.groupBy("table").agg(F.count_if(error).alias("constraints_checked"), F.sum(F.when(error, F.col("violations")).otherwise(0)).alias("violations"), F.sum(F.when(~error, F.col("violations")).otherwise(0)).alias("warnings"))
