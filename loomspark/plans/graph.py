"""The order in which tables are generated: parents before children, cycles cut at a nullable foreign key."""

from __future__ import annotations

from dataclasses import dataclass, field

from .model import Reference, Schema, SchemaError


@dataclass
class Plan:
    order: list[str] = field(default_factory=list)
    deferred: list[tuple[str, Reference]] = field(default_factory=list)

    def deferred_columns(self, table: str) -> set[str]:
        return {c for t, fk in self.deferred if t == table for c in fk.columns}


def nullable(schema: Schema, table: str, fk: Reference) -> bool:
    t = schema[table]
    return all(t.row[c].nullable and c not in t.key for c in fk.columns)


def plan_generation(schema: Schema) -> Plan:
    """Ties go by the order of declaration. Self-references are always deferred; a cycle of keys that are all NOT NULL is an error."""
    plan, waiting = Plan(), {}
    for name, table in schema.items():
        waiting[name] = []
        for fk in table.references:
            if fk.table not in schema:
                raise SchemaError(f"{name} refers to {fk.table}, which is not in the schema")
            if fk.table == name:
                if not nullable(schema, name, fk):
                    raise SchemaError(f"{name}.{', '.join(fk.columns)} refers to its own table and is NOT NULL")
                plan.deferred.append((name, fk))
            else:
                waiting[name].append(fk)
    while waiting:
        ready = [n for n, fks in waiting.items() if all(fk.table not in waiting for fk in fks)]
        if ready:
            plan.order.append(ready[0])
            del waiting[ready[0]]
            continue
        cut = next(((n, fk) for n, fks in waiting.items() for fk in fks if fk.table in waiting and nullable(schema, n, fk) and _in_cycle(n, fk, waiting)), None)
        if cut is None:
            raise SchemaError(f"these tables refer to each other by keys that are NOT NULL: {', '.join(waiting)}")
        plan.deferred.append(cut)
        waiting[cut[0]].remove(cut[1])
    return plan


def _in_cycle(name: str, fk: Reference, waiting: dict) -> bool:
    seen, todo = set(), [fk.table]
    while todo:
        t = todo.pop()
        if t == name:
            return True
        if t in waiting and t not in seen:
            seen.add(t)
            todo += [x.table for x in waiting[t]]
    return False
