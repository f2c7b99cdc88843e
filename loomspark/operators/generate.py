"""Generation: one lazy DataFrame per table, constraint-correct by construction.

Rows are numbered by spark.range, and every value is an expression of that number, so nothing shuffles but the joins that
fetch parents' keys. Each table is written once, since its children read it.
"""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.draws import below, uniform
from ..functions.permute import Permutation
from ..plans import differences as D
from ..plans import model as M
from ..plans.checks import within
from ..plans.config import Config
from ..plans.graph import Plan, plan_generation
from ..plans.rows import Fanout, check_fanout
from ..sources.pools import Pool, load_pools, pool_groups
from ..storage import compiled, materialise
from . import coherence as C
from . import keys as K
from .compared import Bind, Steps, let, unsettled
from .compared import draw as draw_compared

ATTEMPTS = 50
AT_ONCE = 4  # tables that are made side by side


def _date(v) -> dt.date:
    return v.date() if isinstance(v, dt.datetime) else v


def independent(table: M.Table, c: T.StructField, row: Column, n: int, config: Config, salt: str = "", weights: tuple | None = None, alone: bool | None = None, limits: tuple = (None, None)) -> Column:
    """A column's value from its type, bounds and hint, without nulls; alone: different for each row (None: if the table says so);
    limits: (lowest, highest) besides the bounds of its checks."""
    alone = c.name in table.lone if alone is None else alone
    length = c.metadata.get("length")
    parts = (config.seed, table.name, c.name, *([salt] if salt else []))
    low, high, listed = M.bounds(table, c)
    low, high = (best([v for v in pair if v is not None], default=None) for best, pair in ((max, (low, limits[0])), (min, (high, limits[1]))))
    domain = c.metadata.get("domain") if c.metadata.get("domain") is not None else listed
    kind = c.dataType
    if low is not None and high is not None and low > high:
        raise M.DomainExhausted(f"{table.name}.{c.name}: no value from {low} to {high}")
    if domain is not None:
        if not any(isinstance(v, str) for v in domain):
            domain = [v for v in domain if (low is None or v >= low) and (high is None or v <= high)]
        if not domain:
            raise M.DomainExhausted(f"{table.name}.{c.name} has no allowed value")
        if alone:
            if n > len(domain):
                raise M.DomainExhausted(f"{table.name}.{c.name}: {n} different values of {len(domain)}")
            return F.element_at(F.array(*[F.lit(v) for v in domain]), (Permutation(len(domain), *parts).of(row - 1) + 1).cast("int")).cast(kind)
        made = V.weighted(row, list(domain), [round(w * 1000) for w in weights], *parts) if weights else V.choice(row, list(domain), *parts)
        return made.cast(kind)
    if c.metadata["sql"] in M.WHOLE:
        lo = -(-low // 1) if low is not None else None
        hi = high // 1 if high is not None else None
        lo = int(lo) if lo is not None else (min(1, int(hi) - 1000) if hi is not None else 1)
        hi = int(hi) if hi is not None else lo + max(1000, 2 * n if alone else 0)
        if hi < lo or (alone and hi - lo + 1 < n):
            raise M.DomainExhausted(f"{table.name}.{c.name}: {n} values from {lo} to {hi}")
        return (F.lit(lo) + Permutation(hi - lo + 1, *parts).of(row - 1) if alone else V.integer(row, lo, hi, *parts)).cast(kind)
    if c.metadata["sql"] in ("NUMERIC", "FLOAT"):
        precision, scale = (c.dataType.precision, c.dataType.scale) if c.metadata["sql"] == "NUMERIC" else (38, 2)
        step = Decimal(1).scaleb(-scale)
        cap = Decimal(10) ** (precision - scale) - step if precision < 38 else Decimal(10) ** 12
        lo = Decimal(low) if low is not None else (min(step, Decimal(high) - 10000) if high is not None else step)
        lo, hi = max(lo, -cap), min(Decimal(high) if high is not None else max(lo, Decimal(10000)), cap)
        if hi < lo:
            raise M.DomainExhausted(f"{table.name}.{c.name}: no value from {lo} to {hi}")
        if alone:
            first, span = int(lo / step), int(hi / step) - int(lo / step) + 1
            if span < n:
                raise M.DomainExhausted(f"{table.name}.{c.name}: {n} different values from {lo} to {hi}")
            return ((F.lit(first) + Permutation(span, *parts).of(row - 1)).cast("decimal(38,0)") * F.lit(step)).cast(kind)
        if c.metadata.get("hint") == "money" and scale >= 2 and hi > 0:
            return V.money(row, float(max(lo, Decimal("0.01"))), float(hi), min(38, precision), scale, *parts).cast(kind)
        return V.numeric(row, lo, hi, min(38, precision), scale, *parts).cast(kind)
    if c.metadata["sql"] == "BOOLEAN":
        name = c.name.lower()
        p = 0.85 if any(x in name for x in ("active", "enabled", "verified")) else 0.08 if any(x in name for x in ("deleted", "banned", "blocked", "archived")) else 0.5
        return V.boolean(row, p, *parts)
    if c.metadata["sql"] in M.TIMED:
        hi = _date(high) if high is not None else config.as_of
        lo = _date(low) if low is not None else hi - dt.timedelta(days=V.WINDOW_DAYS)
        if low is not None and high is None and lo > hi:
            hi = lo + dt.timedelta(days=365)
        if alone:
            if (hi - lo).days + 1 < n and c.metadata["sql"] == "DATE":
                raise M.DomainExhausted(f"{table.name}.{c.name}: {n} different days from {lo} to {hi}")
            if c.metadata["sql"] == "DATE":
                return F.date_add(F.lit(lo), Permutation((hi - lo).days + 1, *parts).of(row - 1).cast("int"))
            span = max(1, (hi - lo).days * 86400)
            if span < n:
                raise M.DomainExhausted(f"{table.name}.{c.name}: {n} different seconds from {lo} to {hi}")
            return C.moment(C.seconds(F.lit(dt.datetime.combine(lo, dt.time()))) + Permutation(span, *parts).of(row - 1))
        if c.metadata["sql"] == "DATE":
            return V.date(row, lo, hi, *parts)
        at = lambda v, d: v if isinstance(v, dt.datetime) else dt.datetime.combine(d, dt.time())
        return V.timestamp(row, at(low, lo), at(high, hi), *parts)
    if c.metadata["sql"] == "UUID":
        return V.uuid4(row, *parts)
    made = V.text(row, c.metadata.get("hint"), length, *parts)
    if alone:
        if length and 36**length < 2 * n:
            raise M.DomainExhausted(f"{table.name}.{c.name}: {n} different texts of {length} characters")
        return V.unique_text(made, row, length)
    return made


def _single_key(table: M.Table, c: T.StructField, row: Column, n: int, config: Config) -> Column:
    if c.metadata["sql"] in M.WHOLE:
        low, _, _ = M.bounds(table, c)
        return (row + (int(low) - 1 if low is not None else 0)).cast(c.dataType)
    return independent(table, c, row, n, config, alone=True)


class Generator:
    def __init__(self, spark: SparkSession, schema: M.Schema, counts: dict[str, int | Fanout], config: Config, pools: list[Pool] | None = None):
        self.spark, self.schema, self.specs, self.config = spark, schema, counts, config
        self.pools = load_pools(config.pools, spark) if pools is None else pools
        self.plan: Plan = plan_generation(schema)
        self.made: dict[str, DataFrame] = {}
        self.n: dict[str, int] = {}

    def run(self) -> dict[str, DataFrame]:
        with compiled(self.spark):
            return self._run()

    def _run(self) -> dict[str, DataFrame]:
        if missing := [t for t in self.plan.order if t not in self.specs]:
            raise M.SchemaError(f"no row count for {', '.join(missing)}")
        waiting = list(self.plan.order)
        with ThreadPoolExecutor(AT_ONCE) as pool:  # tables whose parents are there don't wait for each other
            while waiting:
                ready = [t for t in waiting if not self._parents(t) & set(waiting)]
                self.made |= zip(ready, pool.map(lambda t: materialise(self.table(t), t), ready), strict=True)
                waiting = [t for t in waiting if t not in ready]
        for name, fk in self.plan.deferred:
            self.made[name] = materialise(self.backfill(name, fk), name)
        return {n: self.made[n].select(*[f"`{c.name}`" for c in t.row]) for n, t in self.schema.items()}

    def _parents(self, name: str) -> set[str]:
        """Tables that must be there before one."""
        spec = self.specs[name]
        own = {fk.table for fk in self.schema[name].references if not set(fk.columns) & self.plan.deferred_columns(name)}
        return (own | ({spec.parent} if isinstance(spec, Fanout) else set())) & set(self.plan.order) - {name}

    def numbered(self) -> dict[str, DataFrame]:
        """The same with the row number in _rid."""
        return self.made

    def table(self, name: str) -> DataFrame:
        table, config, seed = self.schema[name], self.config, self.config.seed
        deferred = self.plan.deferred_columns(name)
        spec, rid = self.specs[name], F.col("rid")
        pinned = None
        if isinstance(spec, Fanout):
            check_fanout(self.schema, self.plan, name, spec, set(self.n))
            rows, n = K.allocate(self.spark, self.n[spec.parent], lambda rid: spec.children(rid, seed, name), seed, name)
            pinned = next(fk for fk in table.references if fk.table == spec.parent)
        else:
            n = spec
            rows = self.spark.range(1, n + 1).select(F.col("id").alias("rid"))
        self.n[name] = n

        keys = [fk for fk in table.references if not set(fk.columns) & deferred]
        for fk in keys:
            if not self.n[fk.table] and n and not _may_be_null(table, fk):
                raise M.DomainExhausted(f"{name}.{', '.join(fk.columns)} needs a row of {fk.table}, which has none")
        picks: dict[int, Column] = {}
        rows = self._groups(table, keys, rows, n, picks, pinned)
        rewritten = config.coherence and C.anchor_of(table) in C.movable(table, "created", deferred) + C.movable(table, "started", deferred)  # else parents' anchors aren't looked at
        anchors: list[Column] = []
        values: dict[str, Column] = {}
        for i, fk in enumerate(keys):
            rows = self._pick(table, i, fk, rows, n, picks, fk is pinned)
            parent, pick = self.schema[fk.table], F.col(f"_pick{i}")
            anchor = C.anchor_of(parent) if rewritten else None
            computed = fk.to == parent.key and not {*fk.to} & {c for r in parent.references for c in r.columns} and len(fk.to) == 1
            if anchor or not computed:
                got = self.made[fk.table].select(F.col("_rid").alias(f"_pick{i}"), *[F.col(f"`{r}`").alias(f"_key{i}_{j}") for j, r in enumerate(fk.to) if not computed], *([F.col(f"`{anchor}`").cast("timestamp_ntz").alias(f"_anchor{i}")] if anchor else []))
                rows = rows.join(got, f"_pick{i}", "left")
            if computed:  # a key is a function of its row's number
                made = _single_key(parent, parent.row[fk.to[0]], pick, self.n[fk.table], config)
                # whole numbers and UUIDs of no row are null by themselves
                values.setdefault(fk.columns[0], made if parent.row[fk.to[0]].metadata["sql"] in (*M.WHOLE, "UUID") else F.when(pick.isNotNull(), made))
            else:
                for j, c in enumerate(fk.columns):
                    values.setdefault(c, F.col(f"_key{i}_{j}"))
            if anchor:
                anchors.append(F.col(f"_anchor{i}"))

        rows, bound = self._pooled(table, rows, n, {*values, *deferred, *table.key})
        values |= bound
        for c in deferred:
            values[c] = F.lit(None).cast(table.row[c].dataType)
        if len(table.key) == 1 and table.key[0] not in values:
            values[table.key[0]] = _single_key(table, table.row[table.key[0]], rid, n, config)
        given = dict(values)
        ranges = {c: self._range(table, c, keys, n) for c in given}
        systems = D.systems(table, [*given, *self._alone(table), *(c.name for c in table.row if c.metadata.get("domain") is not None)], {c: r for c, r in ranges.items() if r}, set(deferred))
        free = [c.name for c in table.row if c.name not in given]
        steps = Steps(rows)  # values that others follow get columns of their own
        values |= self._drawn(table, free, systems, given, rid, n, steps, dict)
        rows = steps.rows
        rows = self._filtered(table, rows, values, given, systems, n)
        if config.coherence:
            rows, values = self._coherent(table, rows, values, anchors, deferred, [fk for fk in table.references if fk.table == name])
        columns = [values[c.name].cast(c.dataType).alias(c.name) for c in table.row]
        return rows.select(F.col("rid").alias("_rid"), *columns)

    def _range(self, table: M.Table, c: str, keys: list, n: int) -> tuple | None:
        """The lowest and the highest of a key's values, where they are computed from row numbers."""
        if table.row[c].metadata["sql"] not in M.WHOLE:
            return None
        if table.key == [c] and not any(c in fk.columns for fk in keys):
            low = M.bounds(table, table.row[c])[0]
            first = int(low) if low is not None else 1
            return (first, first + n - 1) if n else None
        fk = next((fk for fk in keys if fk.columns == [c]), None)
        if fk and fk.to == self.schema[fk.table].key and not any(fk.to[0] in r.columns for r in self.schema[fk.table].references):
            return self._range(self.schema[fk.table], fk.to[0], [], self.n[fk.table])
        return None

    def _alone(self, table: M.Table) -> set[str]:
        """Columns whose values differ from row to row on their own."""
        return table.lone | {g[-1] for g in self._free_groups(table)}

    def _drawn(self, table: M.Table, names: list[str], systems: list, given: dict[str, Column], rid: Column, n: int, bind: Bind, then: Callable[[dict[str, Column]], object], salt: str = ""):
        """then(values, with nulls, of columns that aren't given). salt: of another attempt, in which rid is no number."""
        parts = (self.config.seed, table.name, *([salt] if salt else []))

        def with_nulls(made: dict[str, Column]) -> dict[str, Column]:
            return {c: self._nulls(table, table.row[c], v.cast(table.row[c].dataType), rid, salt) for c, v in made.items()}

        def go(left: list, out: dict[str, Column]):
            if not left:
                compared = {c for s in systems for c in s.columns}
                return then(out | with_nulls({c: self._own(table, table.row[c], rid, n, salt) for c in names if c not in compared}))
            s = left[0]
            own = {c: v for c, v in given.items() if c in s.columns}
            return draw_compared(s, own, lambda c, limits: self._own(table, table.row[c], rid, n, salt, limits), self._distinct(table), rid, bind, lambda made: go(left[1:], out | with_nulls(made)), *parts)

        return go([s for s in systems if set(s.columns) & set(names)], {})

    def _distinct(self, table: M.Table) -> set[str]:
        return self._alone(table) | (set(table.key) if len(table.key) == 1 else set())

    def _own(self, table: M.Table, c: T.StructField, rid: Column, n: int, salt: str = "", limits: tuple = (None, None)) -> Column:
        o, alone = self.config.columns.get(f"{table.name}.{c.name}"), c.name in self._alone(table)
        return independent(table, c, rid, n, self.config, salt, o.weights if o and not alone else None, alone, limits)

    def _free_groups(self, table: M.Table) -> list[list[str]]:
        """Composite keys with a member that may have a value of its own for every row; that member makes them unique."""
        in_keys = {c for fk in table.references for c in fk.columns}
        out = []
        for group in [*table.groups, *([table.key] if len(table.key) > 1 else [])]:
            free = [c for c in group if c not in in_keys and table.row[c].metadata.get("domain") is None and table.row[c].metadata["sql"] != "BOOLEAN" and M.bounds(table, table.row[c])[2] is None]
            if free:
                out.append([*group, free[-1]])
        return out

    def _groups(self, table: M.Table, keys: list, rows: DataFrame, n: int, picks: dict, pinned) -> DataFrame:
        """Composite keys of foreign keys only: different combinations of parents."""
        free = {tuple(g[:-1]) for g in self._free_groups(table)}
        for group in [*([table.key] if len(table.key) > 1 else []), *table.groups]:
            members = [i for i, fk in enumerate(keys) if set(fk.columns) & set(group)]
            if tuple(group) in free or not members or any(i in picks for i in members) or {c for i in members for c in keys[i].columns} < set(group):
                continue
            parts, rid = (self.config.seed, table.name, *group), F.col("rid")
            sizes = [self.n[keys[i].table] for i in members]
            at = next((k for k, i in enumerate(members) if keys[i] is pinned), None)
            if at is None:
                for i, cell in zip(members, K.cells(sizes, n, rid, *parts), strict=True):
                    picks[i] = cell
            else:
                # a parent's children take different combinations of the other members
                rest = [s for k, s in enumerate(sizes) if k != at]
                total = 1
                for s in rest:
                    total *= s
                if n and rows.agg(F.max("place")).first()[0] > total:
                    raise M.DomainExhausted(f"{table.name}: a row of {keys[members[at]].table} has more children than there are combinations ({total})")
                cell = F.pmod(F.col("place") * K.multiplier(total) + below(total, F.col("pick"), *parts), F.lit(total))
                picks[members[at]] = F.col("pick")
                for k in reversed([k for k in range(len(members)) if k != at]):
                    picks[members[k]] = (F.pmod(cell, F.lit(sizes[k])) + 1).cast("long")
                    cell = F.floor(cell / F.lit(sizes[k]))
        return rows

    def _pick(self, table: M.Table, i: int, fk: M.Reference, rows: DataFrame, n: int, picks: dict, pinned: bool) -> DataFrame:
        name, m, parts = f"_pick{i}", self.n[fk.table], (self.config.seed, table.name, *fk.columns)
        rid = F.col("rid")
        if i in picks:
            return rows.withColumn(name, picks[i])
        if pinned:
            return rows.withColumn(name, F.col("pick"))
        if not m:
            return rows.withColumn(name, F.lit(None).cast("long"))
        alone = len(fk.columns) == 1 and (fk.columns[0] in table.lone or table.key == fk.columns)
        if alone:
            return rows.withColumn(name, K.permuted_pick(m, n, rid, *parts))
        if self.config.fanout == "zipfian":
            rows = K.zipf_pick(rows.withColumnRenamed("pick", "_pinned") if "pick" in rows.columns else rows, m, *parts).withColumnRenamed("pick", name)
            rows = rows.withColumnRenamed("_pinned", "pick") if "_pinned" in rows.columns else rows
        else:
            rows = rows.withColumn(name, K.uniform_pick(m, rid, *parts))
        if _may_be_null(table, fk):
            rows = rows.withColumn(name, V.nullable(F.col(name), self.config.fk_null_rate, rid, *parts))
        return rows

    def _nulls(self, table: M.Table, c: T.StructField, made: Column, rid: Column | None = None, salt: str = "") -> Column:
        if M.filled(table, c.name) or c.name in table.key:
            return made
        return V.nullable(made, self.config.null_rate, F.col("rid") if rid is None else rid, self.config.seed, table.name, c.name, *([salt] if salt else []))

    @staticmethod
    def _within(made: Column, c: T.StructField, low_high: tuple) -> Column:
        low, high = low_high
        if c.metadata["sql"] in M.TIMED:
            kind = "date" if c.metadata["sql"] == "DATE" else "timestamp_ntz"
            made = F.greatest(made.cast(kind), F.lit(low).cast(kind)) if low is not None else made
            return F.least(made.cast(kind), F.lit(high).cast(kind)) if high is not None else made
        if c.metadata["sql"] == "NUMERIC":
            cap = Decimal(10) ** (c.dataType.precision - c.dataType.scale) - Decimal(1).scaleb(-c.dataType.scale)
            high = cap if high is None else min(high, cap)
        made = F.greatest(made, F.lit(low)) if low is not None else made
        return F.least(made, F.lit(high)) if high is not None else made

    def _pooled(self, table: M.Table, rows: DataFrame, n: int, taken: set[str]) -> tuple[DataFrame, dict[str, Column]]:
        """Columns of one pool come from one record a row."""
        out: dict[str, Column] = {}
        if not self.config.coherence:
            return rows, out
        for k, (pool, columns) in enumerate(pool_groups(table, self.pools, taken)):
            rid, parts = F.col("rid"), (self.config.seed, table.name, "pool", pool.name)
            if any(c.name in table.lone for c, _ in columns):
                if n > len(pool):
                    warnings.warn(f"{table.name}: {n} rows need different records of pool {pool.name}, which has {len(pool)}", stacklevel=2)
                    continue
                at = Permutation(len(pool), *parts).of(rid - 1)
            else:
                at = below(len(pool), rid, *parts)
            priced = [f for f in ("price_min", "price_max") if f in pool.fields]
            rows, record = pool.add_record(rows, at, f"_record{k}", list(dict.fromkeys([f for _, f in columns] + priced))), F.col(f"_record{k}")
            for c, key in columns:
                text = F.coalesce(record.getField(key), V.text(rid, c.metadata.get("hint"), None, *parts, "else"))  # a record may lack a field
                out[c.name] = self._nulls(table, c, F.substring(text, 1, c.metadata.get("length")) if c.metadata.get("length") else text)
            price = next((c for c in table.row if c.metadata.get("hint") == "money" and c.metadata["sql"] in ("NUMERIC", "FLOAT") and c.name not in table.lone and c.name not in taken and c.metadata.get("domain") is None), None)
            if price is not None and {"price_min", "price_max"} <= pool.fields:
                lo, hi = record.getField("price_min").cast("double"), record.getField("price_max").cast("double")
                made = (lo + F.floor(uniform(rid, *parts, "price") * (hi - lo + 1))).cast("decimal(20,2)") - F.lit(Decimal("0.01"))
                made = F.greatest(made, lo.cast("decimal(20,2)"))
                out[price.name] = self._nulls(table, price, self._within(made, price, M.bounds(table, price)[:2]))
        return rows, out

    def _filtered(self, table: M.Table, rows: DataFrame, values: dict[str, Column], given: dict[str, Column], systems: list, n: int) -> DataFrame:
        """Draws the columns of checks that the facts don't settle again, until all of them hold; ATTEMPTS times at most. Checks that share
        columns, or columns of one system, are drawn together."""
        loose = {p for s in systems for x, y in unsettled(s, set(given), self._distinct(table)) for p in ((x, y), (y, x))}
        ensured = {(x, y) for s in systems for x in s.columns for y in s.columns} - loose
        fixed = {*given, *self._alone(table)}
        groups: list[tuple[list[M.Check], set[str]]] = []
        for check in table.checks:
            pairs = [(f[1], f[3]) for f in check.facts if f[0] == "compare"]
            if check.enough and all(p in ensured for p in pairs):
                continue
            if not evaluable(self.spark, table, check):
                warnings.warn(f"{table.name}: Spark can't evaluate CHECK ({check.sql}), so it isn't looked at", stacklevel=2)
                continue
            if not set(check.columns) - fixed:
                warnings.warn(f"{table.name}: CHECK ({check.sql}) is on keys and unique columns only, so it may not hold", stacklevel=2)
                continue
            columns = set(check.columns) | {c for s in systems for c in s.columns if set(s.columns) & set(check.columns)}
            joined = [g for g in groups if g[1] & (columns - fixed)]
            groups = [g for g in groups if g not in joined] + [([*(c for g in joined for c in g[0]), check], columns.union(*(g[1] for g in joined)))]
        for k, (checks, columns) in enumerate(groups):
            free = [c.name for c in table.row if c.name in columns - fixed]
            seen = {c: values[c].cast(table.row[c].dataType) for c in sorted(columns)}
            kept = {c: v for c, v in values.items() if c in columns and c in fixed}

            def draw(attempt: Column, *, again: str = f"again{k}", free=free, kept=kept, seen=seen) -> Column:
                def struct(made: dict[str, Column]) -> Column:
                    return F.struct(*[(made[c].cast(table.row[c].dataType) if c in made else v).alias(c) for c, v in seen.items()])

                rid = F.concat_ws("/", F.col("rid").cast("string"), attempt.cast("string"))
                return self._drawn(table, free, systems, {**given, **kept}, rid, n, let, struct, again)

            def holds(struct: str, checks=checks, columns=columns) -> str:
                return " AND ".join(f"coalesce({within(c, table, struct, list(columns))}, true)" for c in checks)

            rows = materialise(first_that_holds(rows, F.struct(*[v.alias(c) for c, v in seen.items()]), draw, holds, f"_kept{k}"), f"{table.name}-drawn")
            if not rows.filter(f"_kept{k} is null").isEmpty():
                raise M.DomainExhausted(f"{table.name}: no values satisfy {' and '.join(c.sql for c in checks)} in {ATTEMPTS} draws")
            for c in free:
                values[c] = F.col(f"_kept{k}")[c]
        return rows

    def _coherent(self, table: M.Table, rows: DataFrame, values: dict[str, Column], anchors: list[Column], deferred: set[str], own_keys: list) -> tuple[DataFrame, dict[str, Column]]:
        """Times in order: anchors after parents' ones (or, in a hierarchy of its own without parents, in the order of rows), and
        what follows an anchor after it."""
        name, rid, seed = C.anchor_of(table), F.col("rid"), self.config.seed
        if not name:
            return rows, values
        out, steps = dict(values), Steps(rows, "_life")
        cap = F.lit(dt.datetime.combine(self.config.as_of, dt.time())).cast("timestamp_ntz")

        def known(c: str) -> Column:
            """Whether a value that no rule pins isn't null, told by the draw of nulls alone."""
            return F.lit(True) if M.filled(table, c) or c in table.key else V.present(self.config.null_rate, rid, seed, table.name, c)

        anchor = values[name].cast("timestamp_ntz")
        if name in C.movable(table, "created", deferred) + C.movable(table, "started", deferred):
            if anchors:
                anchor = C.clamp(C.rewrite_anchor(anchor, C.floor_of(anchors), cap, rid, seed, table.name, name, known=known(name), bind=steps.column), *M.bounds(table, table.row[name])[:2])
            elif own_keys:
                rows = materialise(rows.withColumn("_anchor", anchor), f"{table.name}-anchors")
                slots = K.sort_anchors(rows.select("rid", F.col("_anchor").alias("anchor"))).withColumnRenamed("anchor", "_sorted")
                steps.rows, anchor = rows.drop("_anchor").join(slots, "rid"), F.col("_sorted")
            if table.row[name].metadata["sql"] == "DATE":
                anchor = anchor.cast("date").cast("timestamp_ntz")
            out[name] = anchor = steps.column(anchor)
        elif len(C.later(table, deferred)) > 1:
            anchor = steps.column(anchor)

        def kept(c: str, at: Column) -> Column:
            return C.clamp(at, *M.bounds(table, table.row[c])[:2])

        stages = [c for c in C.later(table, deferred) if table.row[c].metadata["role"] == "stage"]
        for c in C.movable(table, "updated", deferred):
            out[c] = kept(c, C.updated_at(values[c].cast("timestamp_ntz"), anchor, cap, rid, seed, table.name, c, known=known(c)))
        for c in C.movable(table, "last_use", deferred):
            out[c] = kept(c, C.last_seen(values[c].cast("timestamp_ntz"), anchor, cap, rid, seed, table.name, c, known=known(c)))
        by = C.status_of(table, stages)
        status = steps.column(values[by].cast("string")) if by else None
        if by:
            out[by] = status
        gated = [(c, values[c], C.filled(status, F.when(known(c), F.lit(1)), C.stage_of(table, c), M.filled(table, c))) for c in stages]
        for (c, _, _), at in zip(gated, C.lifecycle(anchor, gated, rid, seed, table.name, bind=steps.column), strict=True):
            out[c] = kept(c, at)
        return steps.rows, out

    def backfill(self, name: str, fk: M.Reference) -> DataFrame:
        """Fills a deferred key: with an earlier row of the same table, or with a parent that is not later."""
        table, config, parts = self.schema[name], self.config, (self.config.seed, name, *fk.columns)
        rows, parent = self.made[name], self.made[fk.table]
        own, theirs = C.anchor_of(table), C.anchor_of(self.schema[fk.table])
        start = F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz")

        def anchored(df: DataFrame, anchor: str | None) -> DataFrame:
            return df.select(F.col("_rid").alias("rid"), (F.coalesce(F.col(f"`{anchor}`").cast("timestamp_ntz"), start) if anchor else start).alias("anchor"))

        if fk.table == name:
            share = config.deferred_fk_null_rate if config.root_fraction is None else config.root_fraction
            picked = K.forest_parents(anchored(rows, own), share, *parts).select("rid", F.col("parent").alias("pick"))
        else:
            both = own and theirs
            picked = K.earlier_pick(anchored(rows, own if both else None), anchored(parent, theirs if both else None), config.deferred_fk_null_rate, *parts).select("rid", "pick")
        got = parent.select(F.col("_rid").alias("pick"), *[F.col(f"`{r}`").alias(f"_key{j}") for j, r in enumerate(fk.to)])
        joined = rows.drop(*fk.columns).join(picked.join(got, "pick", "left").withColumnRenamed("rid", "_rid").drop("pick"), "_rid")
        for j, c in enumerate(fk.columns):
            joined = joined.withColumnRenamed(f"_key{j}", c)
        return joined.select("_rid", *[f"`{c.name}`" for c in table.row])


def _may_be_null(table: M.Table, fk: M.Reference) -> bool:
    return all(table.row[c].nullable and c not in table.key for c in fk.columns)


def evaluable(spark: SparkSession, table: M.Table, check: M.Check) -> bool:
    """Whether Spark can read a check over a table's columns."""
    try:
        return spark.createDataFrame([], table.row).select(F.expr(check.sql).cast("boolean")).columns is not None
    except (ParseException, AnalysisException):
        return False


def first_that_holds(rows: DataFrame, first: Column, draw: Callable[[Column], Column], sql: Callable[[str], str], name: str) -> DataFrame:
    """rows with a struct of the first values under which the check, sql(struct), doesn't fail: first, or a draw by the number of its attempt,
    from 1 to ATTEMPTS; null if there is none. All within a row; later draws are made for rows without an earlier one only."""
    columns, won = [F.col(f"`{c}`") for c in rows.columns], None
    for low, high in ((0, 0), (1, 7), (8, ATTEMPTS)):
        made = F.array(first) if not high else F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: draw(k))
        rows = rows.select(*columns, *([] if won is None else [name]), (made if won is None else F.when(F.col(name).isNull(), made)).alias("_draws"))
        won = F.lit(None)
        for i in reversed(range(high - low + 1)):
            holds = F.coalesce(F.expr(sql(f"_draws[{i}]")), F.lit(True))
            won = F.when(holds, F.get("_draws", F.lit(i))).otherwise(won)
        rows = rows.select(*columns, (F.coalesce(F.col(name), won) if high else won).alias(name))
    return rows


def generate(spark: SparkSession, schema: M.Schema, rows: dict[str, int | Fanout], config: Config | None = None) -> dict[str, DataFrame]:
    """A DataFrame for each table of the schema."""
    return Generator(spark, schema, rows, config or Config()).run()
