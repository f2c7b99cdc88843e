"""Settings: defaults, TOML files and column overrides."""

from __future__ import annotations

import datetime as dt
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from .model import WHOLE, Check, Schema, bounds
from .rows import ConfigError, Fanout, parse_rows


@dataclass(frozen=True)
class Override:
    values: tuple | None = None
    weights: tuple | None = None
    min: object = None
    max: object = None


@dataclass(frozen=True)
class Config:
    seed: int = 42
    as_of: dt.date = dt.date(2026, 1, 1)
    null_rate: float = 0.05
    fk_null_rate: float = 0.1
    deferred_fk_null_rate: float = 0.2
    root_fraction: float | None = None
    fanout: str = "zipfian"
    coherence: bool = True
    pools: tuple[str, ...] = ()
    rows: dict[str, int | Fanout] = field(default_factory=dict)
    columns: dict[str, Override] = field(default_factory=dict)

    def with_flags(self, **flags) -> Config:
        """Flags that are given win over the file's settings."""
        return replace(self, **{k: v for k, v in flags.items() if v is not None})


_RATES = ("null_rate", "fk_null_rate", "deferred_fk_null_rate", "root_fraction")


def load(path: str | Path) -> Config:
    """[project] seed, as_of; [rows]; [generation]; [columns."table.column"]."""
    try:
        raw = tomllib.loads(Path(path).read_text())
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from None
    if unknown := set(raw) - {"project", "rows", "generation", "columns"}:
        raise ConfigError(f"{path}: unknown sections {', '.join(sorted(unknown))}")
    project, generation = raw.get("project", {}), raw.get("generation", {})
    out: dict = {}
    if "seed" in project:
        if isinstance(project["seed"], bool) or not isinstance(project["seed"], int):
            raise ConfigError("[project] seed must be an integer")
        out["seed"] = project["seed"]
    if "as_of" in project:
        v = project["as_of"]
        try:
            out["as_of"] = v if isinstance(v, dt.date) and not isinstance(v, dt.datetime) else dt.date.fromisoformat(v)
        except (TypeError, ValueError):
            raise ConfigError("[project] as_of must be a date") from None
    for k, v in generation.items():
        if k in _RATES:
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1:
                raise ConfigError(f"[generation] {k} must be from 0 to 1")
            out[k] = float(v)
        elif k == "fanout":
            if v not in ("uniform", "zipfian"):
                raise ConfigError("[generation] fanout must be uniform or zipfian")
            out[k] = v
        elif k == "coherence":
            out[k] = bool(v)
        elif k == "pools":
            out[k] = tuple(v)
        else:
            raise ConfigError(f"[generation] has no setting {k}")
    out["rows"] = {t: parse_rows(v) if not isinstance(v, bool) else _no(t) for t, v in raw.get("rows", {}).items()}
    out["columns"] = {name: _override(name, v) for name, v in raw.get("columns", {}).items()}
    return Config(**out)


def _no(table: str):
    raise ConfigError(f"[rows] {table} must be a number or LOW..HIGH per PARENT")


def _override(name: str, v: dict) -> Override:
    if name.count(".") != 1:
        raise ConfigError(f'[columns] "{name}" must be table.column')
    if unknown := set(v) - {"values", "weights", "min", "max"}:
        raise ConfigError(f"[columns.{name}] has no setting {', '.join(sorted(unknown))}")
    if "weights" in v and ("values" not in v or len(v["weights"]) != len(v["values"]) or any(isinstance(w, bool) or w < 0 for w in v["weights"]) or not sum(v["weights"])):
        raise ConfigError(f"[columns.{name}] weights must be as many as values, and not all zero")
    if "values" in v and not v["values"]:
        raise ConfigError(f"[columns.{name}] values are empty")
    return Override(tuple(v["values"]) if "values" in v else None, tuple(v["weights"]) if "weights" in v else None, v.get("min"), v.get("max"))


def apply_overrides(schema: Schema, overrides: dict[str, Override]) -> Schema:
    """Narrows columns of the schema, in place. An override never widens what the schema allows."""
    from decimal import Decimal

    for name, o in overrides.items():
        t, c = name.split(".")
        if t not in schema:
            raise ConfigError(f"[columns.{name}]: there is no table {t}")
        table = schema[t]
        try:
            column = table.row[c]
        except KeyError:
            raise ConfigError(f"[columns.{name}]: {t} has no column {c}") from None
        if c in table.key or any(c in fk.columns for fk in table.references):
            raise ConfigError(f"[columns.{name}]: keys can't be overridden")
        if o.values is not None:
            if column.metadata.get("domain") is not None and (extra := set(o.values) - set(column.metadata.get("domain"))):
                raise ConfigError(f"[columns.{name}]: {sorted(map(str, extra))} are not allowed by the schema")
            if column.metadata["sql"] in WHOLE and not all(isinstance(v, int) and not isinstance(v, bool) for v in o.values):
                raise ConfigError(f"[columns.{name}]: values must be integers")
            column.metadata["domain"] = list(o.values)
        if o.min is not None or o.max is not None:
            if column.metadata["sql"] not in (*WHOLE, "NUMERIC", "FLOAT", "DATE", "TIMESTAMP"):
                raise ConfigError(f"[columns.{name}]: min and max need a number, date or time")
            dates = column.metadata["sql"] in ("DATE", "TIMESTAMP")
            if any(v is not None and isinstance(v, (dt.date, str)) != dates for v in (o.min, o.max)):
                raise ConfigError(f"[columns.{name}]: min and max don't fit the type")
            as_value = (lambda v: dt.date.fromisoformat(v) if isinstance(v, str) else v) if dates else (lambda v: Decimal(str(v)))
            for op, v in ((">=", o.min), ("<=", o.max)):
                if v is not None:
                    literal = f"DATE '{v}'" if dates else str(v)
                    table.rules.append(Check(f"{c} {op} {literal}", [c], [("bound", c, op, as_value(v))], True))
            low, high, _ = bounds(table, column)
            if low is not None and high is not None and low > high:
                raise ConfigError(f"[columns.{name}]: nothing is left between {low} and {high}")
    return schema
