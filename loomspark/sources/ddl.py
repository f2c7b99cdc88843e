"""Schemas from CREATE TABLE and ALTER TABLE ... ADD text.

Only what the schema model holds is read. CHECK bodies stay SQL, for Spark to evaluate; plans.checks reads what they say of columns,
so that generation can satisfy them by construction. Names that aren't quoted are found in any case.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

from ..plans.checks import group_at as _group
from ..plans.checks import make_check, resolve, to_sql
from ..plans.checks import name_of as _name
from ..plans.checks import split_list as _split
from ..plans.checks import tokens_of as _tokens
from ..plans.model import WHOLE, Reference, Schema, SchemaError, Table, Unique, column, hint_of

#: Type names and what they mean.
TYPE_NAMES = {
    "INT": "INTEGER", "INTEGER": "INTEGER", "INT4": "INTEGER", "SERIAL": "INTEGER", "BIGINT": "BIGINT", "INT8": "BIGINT", "BIGSERIAL": "BIGINT", "SMALLINT": "SMALLINT", "INT2": "SMALLINT", "SMALLSERIAL": "SMALLINT",
    "NUMERIC": "NUMERIC", "DECIMAL": "NUMERIC", "FLOAT": "FLOAT", "DOUBLE": "FLOAT", "REAL": "FLOAT", "FLOAT8": "FLOAT", "VARCHAR": "VARCHAR", "CHAR": "VARCHAR", "CHARACTER": "VARCHAR", "NVARCHAR": "VARCHAR",
    "TEXT": "TEXT", "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP", "TIMESTAMPTZ": "TIMESTAMP", "DATETIME": "TIMESTAMP", "UUID": "UUID",
}

_STOP = {"NOT", "NULL", "PRIMARY", "UNIQUE", "DEFAULT", "REFERENCES", "CHECK", "CONSTRAINT", "GENERATED", "COLLATE"}


def _names(tokens: list[str]) -> list[str]:
    return [_name(x[0]) for x in _split(tokens)]


def _reference(tokens: list[str], at: int) -> tuple[str, list[str], int]:
    """Table, columns and the place after REFERENCES table (columns)."""
    name, at = _name(tokens[at]), at + 1
    while at < len(tokens) and tokens[at] == ".":
        name, at = _name(tokens[at + 1]), at + 2
    if at < len(tokens) and tokens[at] == "(":
        inner, at = _group(tokens, at)
        return name, _names(inner), at
    return name, [], at


def fit(value, column: T.StructField):
    """A literal as a value of the column's type."""
    if column.metadata["sql"] in WHOLE and isinstance(value, Decimal):
        return int(value)
    if column.metadata["sql"] in ("VARCHAR", "TEXT", "UNKNOWN"):
        return str(value)
    return value


def _add_column(table: Table, tokens: list[str], later: list) -> None:
    name, i = _name(tokens[0]), 1
    kind: list[str] = []
    inner: list[str] = []
    while i < len(tokens) and tokens[i].upper() not in _STOP:
        if tokens[i] == "(":
            inner, i = _group(tokens, i)
        else:
            kind.append(tokens[i].upper())
            i += 1
    sizes = [int(x) for x in inner if x.isdigit()]
    sql = TYPE_NAMES.get(kind[0] if kind else "", "UNKNOWN") if "[" not in kind else "UNKNOWN"
    digits = (sizes[0], sizes[1] if len(sizes) > 1 else 0) if sql == "NUMERIC" and sizes else None
    c = column(name, sql, length=sizes[0] if sql == "VARCHAR" and sizes else None, digits=digits, hint=hint_of(name, table.name))
    table.row.add(c)
    while i < len(tokens):
        word = tokens[i].upper()
        if word == "CONSTRAINT":
            i += 2
        elif word == "NOT" and tokens[i + 1].upper() == "NULL":
            c.nullable, i = False, i + 2
        elif word == "PRIMARY":
            c.nullable, i = False, i + 2
            table.rules.append(Unique([name], True))
        elif word == "UNIQUE":
            table.rules.append(Unique([name]))
            i += 1
        elif word == "DEFAULT":
            i += 1
            start = i
            while i < len(tokens) and tokens[i].upper() not in _STOP - {"NULL"}:
                i = _group(tokens, i)[1] if tokens[i] == "(" else i + 1
            c.metadata["default"] = to_sql(tokens[start:i]).text()
        elif word == "REFERENCES":
            ref, columns, i = _reference(tokens, i + 1)
            table.rules.append(Reference([name], ref, columns))
        elif word == "CHECK":
            body, i = _group(tokens, i + 1)
            later.append((table, body, c))
        else:
            i = _group(tokens, i)[1] if tokens[i] == "(" else i + 1


def _add_constraint(table: Table, tokens: list[str], later: list) -> bool:
    """A table's constraint, named or not; False if it is none."""

    def columns_of(inner: list[str]) -> list[str]:
        names = [c.name for c in table.row]
        return [resolve(x[0], names) or _name(x[0]) for x in _split(inner)]

    if tokens[0].upper() == "CONSTRAINT":
        tokens = tokens[2:]
    word = tokens[0].upper()
    if word in ("PRIMARY", "UNIQUE"):
        columns = columns_of(_group(tokens, 2 if word == "PRIMARY" else 1)[0])
        table.rules.append(Unique(columns, word == "PRIMARY"))
        for c in columns if word == "PRIMARY" else ():
            table.row[c].nullable = False
    elif word == "FOREIGN":
        inner, at = _group(tokens, 2)
        ref, columns, _ = _reference(tokens, at + 1)
        table.rules.append(Reference(columns_of(inner), ref, columns))
    elif word == "CHECK":
        later.append((table, _group(tokens, 1)[0], None))
    else:
        return False
    return True


def parse_ddl(text: str) -> Schema:
    """The schema of all CREATE TABLE statements, with what ALTER TABLE ... ADD adds; statements on unknown tables are ignored."""
    schema, later, alters = {}, [], []
    statements: list[list[str]] = [[]]
    for t in _tokens(text):
        if t == ";":
            statements.append([])
        else:
            statements[-1].append(t)
    for tokens in statements:
        words = [t.upper() for t in tokens]
        if words[:1] == ["CREATE"] and "TABLE" in words[:4]:
            at = words.index("TABLE") + 1
            if words[at : at + 3] == ["IF", "NOT", "EXISTS"]:
                at += 3
            name, at = _name(tokens[at]), at + 1
            while at < len(tokens) and tokens[at] == ".":
                name, at = _name(tokens[at + 1]), at + 2
            table = Table(name)
            items = _split(_group(tokens, at)[0])
            constraints = [x for x in items if x[0].upper() in ("CONSTRAINT", "PRIMARY", "UNIQUE", "FOREIGN", "CHECK")]
            for item in items:
                if not any(item is x for x in constraints):
                    _add_column(table, item, later)
            for item in constraints:
                _add_constraint(table, item, later)
            schema[name] = table
        elif words[:2] == ["ALTER", "TABLE"]:
            alters.append(tokens)
    for tokens in alters:
        words = [t.upper() for t in tokens]
        if "ADD" in words:
            table = schema.get(_name(tokens[words.index("ADD") - 1]))
            if table:
                for item in _split(tokens[words.index("ADD") + 1 :]):
                    item = item[1:] if item[0].upper() == "ADD" else item
                    if not _add_constraint(table, item, later):
                        _add_column(table, item[1:] if item[0].upper() == "COLUMN" else item, later)
    for table, body, c in later:
        check = make_check(body, table)
        if c and check.form and check.form[0] == "in" and check.form[1] == c.name:
            c.metadata["domain"] = [fit(v, c) for v in check.form[2]]  # an inline list is the column's domain
        else:
            table.rules.append(check)
    for fk in (fk for table in schema.values() for fk in table.references):
        fk.table = resolve(fk.table, list(schema)) or fk.table
        if fk.table in schema:
            names = [c.name for c in schema[fk.table].row]
            fk.to = [resolve(c, names) or c for c in fk.to] or list(schema[fk.table].key)
    return schema
