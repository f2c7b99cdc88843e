"""Schemas from a database's catalogue, as the same model as from DDL.

PostgreSQL's catalogue is read by queries through Spark, whose filters are in the queries. Other databases are read by
JDBC's own metadata (tables, columns, keys, references, unique indexes), which is the driver's work: it is the size of a schema; only CHECKs
need a query of the database's own.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checks import make_check, tokens_of
from ..plans.model import Reference, Schema, SchemaError, Table, Unique, column, hint_of
from .ddl import TYPE_NAMES, fit

TABLES = "SELECT c.relname AS table_name FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname = 'public' AND c.relkind = 'r'"
COLUMNS = "SELECT table_name, column_name, ordinal_position, data_type, character_maximum_length, numeric_precision, numeric_scale, is_nullable, column_default FROM information_schema.columns WHERE table_schema = 'public'"
CONSTRAINTS = "SELECT t.relname AS table_name, k.conname AS name, CAST(k.contype AS text) AS contype, pg_get_constraintdef(k.oid) AS definition, k.conkey, k.confkey, k.conrelid::bigint AS rel, k.confrelid::bigint AS ref, r.relname AS ref_table FROM pg_constraint k JOIN pg_class t ON t.oid = k.conrelid JOIN pg_namespace n ON n.oid = t.relnamespace LEFT JOIN pg_class r ON r.oid = k.confrelid WHERE n.nspname = 'public' AND k.contype IN ('p', 'u', 'f', 'c')"
ATTRIBUTES = "SELECT attrelid::bigint AS rel, attnum, attname FROM pg_attribute WHERE attnum > 0 AND NOT attisdropped"

#: Names that a catalogue has for types.
CATALOGUE_TYPES = {"character varying": "VARCHAR", "character": "VARCHAR", "double precision": "FLOAT", "timestamp without time zone": "TIMESTAMP", "timestamp with time zone": "TIMESTAMP"}


def jdbc_options(url: str) -> dict[str, str]:
    """Options for Spark's reader and writer from postgres://user:secret@host:port/name; a JDBC URL stays as it is."""
    if url.startswith("jdbc:"):
        driver = next((d for k, d in DRIVERS.items() if url.startswith(f"jdbc:{k}:")), None)
        return {"url": url} | ({"driver": driver} if driver else {})
    p = urlsplit(normalise_url(url))
    out = {"url": f"jdbc:postgresql://{p.hostname}:{p.port or 5432}{p.path}" + (f"?{p.query}" if p.query else ""), "driver": "org.postgresql.Driver"}
    if p.username:
        out["user"] = unquote(p.username)
    if p.password:
        out["password"] = unquote(p.password)
    return out


#: Drivers by the kind of database that a JDBC URL names.
DRIVERS = {"postgresql": "org.postgresql.Driver", "derby": "org.apache.derby.jdbc.EmbeddedDriver"}
#: CHECKs (table_name, name, definition) of the current schema, by the database's product name.
CHECKS = {"Apache Derby": "SELECT t.TABLENAME, c.CONSTRAINTNAME, k.CHECKDEFINITION FROM SYS.SYSCHECKS k JOIN SYS.SYSCONSTRAINTS c ON k.CONSTRAINTID = c.CONSTRAINTID JOIN SYS.SYSTABLES t ON c.TABLEID = t.TABLEID JOIN SYS.SYSSCHEMAS s ON t.SCHEMAID = s.SCHEMAID WHERE s.SCHEMANAME = CURRENT SCHEMA"}
#: Indexes (index_name) that stand for unique constraints, where JDBC's metadata doesn't call all of them unique: Derby's are not if a column may be null.
UNIQUES = {"Apache Derby": "SELECT g.CONGLOMERATENAME FROM SYS.SYSCONSTRAINTS c JOIN SYS.SYSKEYS k ON c.CONSTRAINTID = k.CONSTRAINTID JOIN SYS.SYSCONGLOMERATES g ON k.CONGLOMERATEID = g.CONGLOMERATEID WHERE c.TYPE = 'U'"}


class Connection:
    """One connection of the driver, without autocommit: for metadata, and for statements of one transaction."""

    def __init__(self, spark: SparkSession, options: dict[str, str]):
        self.jvm, self.options = spark._jvm, options

    def __enter__(self) -> Connection:
        if "driver" in self.options:
            self.jvm.java.lang.Class.forName(self.options["driver"])
        properties = self.jvm.java.util.Properties()
        for k in ("user", "password"):
            if k in self.options:
                properties.setProperty(k, self.options[k])
        self.db = self.jvm.java.sql.DriverManager.getConnection(self.options["url"], properties)
        self.db.setAutoCommit(False)
        self.meta = self.db.getMetaData()
        return self

    def __exit__(self, *_) -> None:
        self.db.rollback()
        self.db.close()

    def commit(self) -> None:
        self.db.commit()

    def rollback(self) -> None:
        self.db.rollback()

    def run(self, statement: str) -> int:
        s = self.db.createStatement()
        try:
            return s.executeUpdate(statement)
        finally:
            s.close()

    def rows(self, found, *names: str) -> list[dict]:
        """A result set's rows; values as text."""
        out = []
        while found.next():
            out.append({n.lower(): found.getString(n) for n in names})
        found.close()
        return out

    def query(self, statement: str, *names: str) -> list[dict]:
        s = self.db.createStatement()
        try:
            return self.rows(s.executeQuery(statement), *names)
        finally:
            s.close()

    def product(self) -> str:
        return self.meta.getDatabaseProductName()

    @staticmethod
    def quote(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def listed(self, names) -> str:
        return ", ".join(map(self.quote, names))

    def _near(self, name: str) -> str:
        """A table's name as the database spells it."""
        own = self.rows(self.meta.getTables(self.db.getCatalog(), self.db.getSchema(), "%", None), "TABLE_NAME")
        found = [r["table_name"] for r in own if r["table_name"].lower() == name.lower()]
        if not found:
            raise SchemaError(f"the database has no table {name}")
        return name if name in found else found[0]

    def table(self, name: str) -> str:
        return self.quote(self._near(name))

    def columns(self, name: str) -> dict[str, str]:
        """By lower-case name, the database's own."""
        return {r["column_name"].lower(): r["column_name"] for r in self.rows(self.meta.getColumns(self.db.getCatalog(), self.db.getSchema(), self._near(name), "%"), "COLUMN_NAME")}


def read_metadata(spark: SparkSession, url: str) -> Schema:
    """The schema of the tables in a database's current schema. Names that the database folded to upper case come in lower case."""
    with Connection(spark, jdbc_options(url)) as db:
        where = (db.db.getCatalog(), db.db.getSchema())
        fold = (lambda n: n.lower() if n is not None and n == n.upper() else n) if db.meta.storesUpperCaseIdentifiers() else (lambda n: n)
        tables = [r["table_name"] for r in db.rows(db.meta.getTables(*where, "%", None), "TABLE_NAME", "TABLE_TYPE") if r["table_type"] == "TABLE"]
        columns, constraints = [], []
        unique = {r["conglomeratename"] for r in db.query(UNIQUES[db.product()], "CONGLOMERATENAME")} if db.product() in UNIQUES else set()
        for name in tables:
            own = db.rows(db.meta.getColumns(*where, name, "%"), "COLUMN_NAME", "TYPE_NAME", "COLUMN_SIZE", "DECIMAL_DIGITS", "IS_NULLABLE", "COLUMN_DEF", "ORDINAL_POSITION")
            for r in sorted(own, key=lambda r: int(r["ordinal_position"])):
                numeric = r["type_name"] in ("NUMERIC", "DECIMAL")
                columns.append({"table_name": fold(name), "column_name": fold(r["column_name"]), "data_type": r["type_name"], "character_maximum_length": int(r["column_size"]) if r["type_name"] in ("VARCHAR", "CHAR") else None, "numeric_precision": int(r["column_size"]) if numeric else None, "numeric_scale": int(r["decimal_digits"] or 0) if numeric else None, "is_nullable": r["is_nullable"], "column_default": r["column_def"]})
            keys: dict[tuple, list] = {}
            for r in db.rows(db.meta.getPrimaryKeys(*where, name), "COLUMN_NAME", "KEY_SEQ", "PK_NAME"):
                keys.setdefault(("p", r["pk_name"], None), []).append((int(r["key_seq"]), fold(r["column_name"]), None))
            references = db.rows(db.meta.getImportedKeys(*where, name), "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME", "KEY_SEQ", "FK_NAME")
            for r in references:
                keys.setdefault(("f", r["fk_name"], fold(r["pktable_name"])), []).append((int(r["key_seq"]), fold(r["fkcolumn_name"]), fold(r["pkcolumn_name"])))
            for r in db.rows(db.meta.getIndexInfo(*where, name, False, False), "COLUMN_NAME", "ORDINAL_POSITION", "INDEX_NAME", "NON_UNIQUE"):
                if r["non_unique"].lower() not in ("false", "0", "f") and r["index_name"] not in unique:
                    continue
                keys.setdefault(("u", r["index_name"], None), []).append((int(r["ordinal_position"]), fold(r["column_name"]), None))
            primary = next((sorted(v) for (kind, _, _), v in keys.items() if kind == "p"), None)
            for (kind, label, ref), v in sorted(keys.items(), key=lambda x: ("puf".index(x[0][0]), str(x[0][1]))):
                if kind == "u" and sorted(v) == primary:  # the index of the primary key
                    continue
                constraints.append({"table_name": fold(name), "name": label, "contype": kind, "cols": [c for _, c, _ in sorted(v)], "ref_table": ref, "ref_cols": [c for _, _, c in sorted(v)] if kind == "f" else None, "definition": None})
        if statement := CHECKS.get(db.product()):
            for r in sorted(db.query(statement, "TABLENAME", "CONSTRAINTNAME", "CHECKDEFINITION"), key=lambda r: r["constraintname"]):
                constraints.append({"table_name": fold(r["tablename"]), "name": r["constraintname"], "contype": "c", "cols": None, "ref_table": None, "ref_cols": None, "definition": r["checkdefinition"]})
    return assemble(sorted(map(fold, tables)), columns, constraints)


def normalise_url(url: str) -> str:
    """postgres:// and postgresql+driver:// as postgresql://."""
    return re.sub(r"^postgres(?:ql)?(?:\+\w+)?://", "postgresql://", url.strip())


def redact(text: str) -> str:
    """Text without the passwords of URLs in it."""
    out = re.sub(r"(://[^:/@\s]+:)[^@\s]+(@)", r"\1***\2", text)
    return re.sub(r"(?i)(password=)[^&\s]+", r"\1***", out)


def query_options(url: str) -> dict[str, str]:
    return dict(parse_qsl(urlsplit(url).query))


def constraint_columns(constraints: DataFrame, attributes: DataFrame, key: str, rel: str, name: str) -> DataFrame:
    """Names of the columns that an array of attribute numbers lists, in its order, by (table_name, name)."""
    each = constraints.filter(F.col(key).isNotNull()).select("table_name", "name", F.col(rel).alias("rel"), F.posexplode(key).alias("pos", "attnum"))
    named = each.join(attributes, ["rel", "attnum"])
    ordered = F.array_sort(F.collect_list(F.struct("pos", "attname")))
    return named.groupBy("table_name", "name").agg(F.transform(ordered, lambda x: x["attname"]).alias(name))


def read_catalogue(spark: SparkSession, url: str, timeout: int | None = None) -> Schema:
    if not jdbc_options(url)["url"].startswith("jdbc:postgresql:"):
        return read_metadata(spark, url)
    options = jdbc_options(url) | ({"loginTimeout": str(timeout)} if timeout else {})
    tables, columns, constraints, attributes = (spark.read.format("jdbc").options(**options).option("query", q).load() for q in (TABLES, COLUMNS, CONSTRAINTS, ATTRIBUTES))
    named = constraints.join(constraint_columns(constraints, attributes, "conkey", "rel", "cols"), ["table_name", "name"], "left")
    named = named.join(constraint_columns(constraints, attributes, "confkey", "ref", "ref_cols"), ["table_name", "name"], "left")
    return assemble(
        [r["table_name"] for r in tables.orderBy("table_name").collect()],
        [r.asDict() for r in columns.orderBy("table_name", "ordinal_position").collect()],
        [r.asDict() for r in named.select("table_name", "name", "contype", "definition", "cols", "ref_table", "ref_cols").orderBy("table_name", "name").collect()],
    )


def plain_check(definition: str) -> str:
    """A catalogue's CHECK as plain SQL: without casts; = ANY (ARRAY[...]) as IN, and >= with <= on one column as BETWEEN."""
    body = re.sub(r"^CHECK\s*", "", definition.strip(), flags=re.I)
    body = re.sub(r"::(?:character varying|double precision|timestamp with(?:out)? time zone|\w+)(?:\(\d+(?:,\s*\d+)?\))?(?:\[\])?", "", body)
    while True:  # parentheses around one name, number or text
        new = re.sub(r"\((-?\d+(?:\.\d+)?|'(?:[^']|'')*'|\"[^\"]+\"|\w+)\)", r"\1", body)
        if new == body:
            break
        body = new
    while m := re.search(r"=\s*ANY\s*(\(+)\s*ARRAY\[(.*?)\]", body, flags=re.I | re.S):
        rest = body[m.end() :]
        for _ in m[1]:  # as many close as have been opened
            rest = rest.lstrip().removeprefix(")")
        body = f"{body[: m.start()]}IN ({m[2]}){rest}"
    while body.startswith("(") and _closes_last(body):
        body = body[1:-1].strip()
    m = re.fullmatch(r"\(?\s*(\w+)\s*>=\s*('[^']*'|-?[\d.]+)\s*\)?\s+AND\s+\(?\s*\1\s*<=\s*('[^']*'|-?[\d.]+)\s*\)?", body, flags=re.I)
    if m:
        return f"{m[1]} BETWEEN {m[2]} AND {m[3]}"
    return body


def _closes_last(s: str) -> bool:
    depth = 0
    for i, c in enumerate(s):
        depth += (c == "(") - (c == ")")
        if not depth:
            return i == len(s) - 1
    return False


def assemble(tables: list[str], columns: list[dict], constraints: list[dict]) -> Schema:
    schema = {t: Table(t) for t in tables}
    for r in columns:
        if r["table_name"] not in schema:
            continue
        kind = str(r["data_type"]).lower()
        sql = CATALOGUE_TYPES.get(kind) or TYPE_NAMES.get(kind.upper(), "UNKNOWN")
        digits = (r["numeric_precision"], r["numeric_scale"] or 0) if sql == "NUMERIC" and r["numeric_precision"] else None
        schema[r["table_name"]].row.add(column(r["column_name"], sql, r["is_nullable"] == "YES", r["character_maximum_length"] if sql == "VARCHAR" else None, digits, default=r["column_default"], hint=hint_of(r["column_name"], r["table_name"])))
    for r in constraints:
        table = schema.get(r["table_name"])
        if table is None:
            continue
        columns_, kind = list(r["cols"] or []), r["contype"]
        if kind in ("p", "u"):
            table.rules.append(Unique(columns_, kind == "p"))
        elif kind == "f":
            table.rules.append(Reference(columns_, r["ref_table"], list(r["ref_cols"] or [])))
        elif kind == "c":
            check = make_check(tokens_of(plain_check(r["definition"])), table)
            if check.form and check.form[0] == "in":
                c = table.row[check.form[1]]
                c.metadata["domain"] = [fit(v, c) for v in check.form[2]]
            else:
                table.rules.append(check)
    return schema
