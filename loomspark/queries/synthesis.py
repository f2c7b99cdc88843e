"""Generation, keys, coherence, pools and row counts over the driver's tables, whose keys are the row numbers."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.draws import SEED, below, below_sql, bits_sql, uniform_sql
from ..functions.permute import permute_sql
from ..operators import coherence as C
from ..operators import keys as K
from ..operators.compared import Steps, draw
from ..operators.generate import first_that_holds
from ..operators.ranking import number_rows, row_buckets
from ..plans.differences import systems
from ..plans.graph import plan_generation
from ..plans.rows import Fanout, capped_plan, integer_plan
from ..sources.ddl import parse_ddl
from ..sources.pools import load_pools

S = SEED
CAP = dt.datetime(1998, 1, 1)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), value.alias("value"))



def _values(name: str, value, sql: str) -> None:
    """A query over the orders' keys: rid and value."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _orders(spark, sf_dir, value(F.col("o_orderkey")))

    QUERIES[name] = run
    SQL[name] = f"SELECT o_orderkey AS rid, {sql} AS value FROM orders"


R = "o_orderkey"
_values("gen_int", lambda r: V.integer(r, -20, 479, S, "t", "int"), f"-20 + {below_sql(500, R, S, 't', 'int')}")
_values("gen_numeric", lambda r: V.numeric(r, Decimal("0.01"), Decimal("99.99"), 4, 2, S, "t", "num").cast("double"), f"CAST(CAST((1 + {below_sql(9999, R, S, 't', 'num')}) AS DECIMAL(18,2)) / 100 AS DOUBLE)")
_CENTS = f"CAST(floor(exp({math.log(1.0)} + {uniform_sql(R, S, 't', 'money')} * ({math.log(10000.0)} - {math.log(1.0)}))) AS BIGINT) * 100 + CASE WHEN {below_sql(100, R, S, 't', 'money', 'charm')} < 70 THEN 99 WHEN {below_sql(100, R, S, 't', 'money', 'charm')} < 85 THEN 95 ELSE 0 END"
_values("gen_money", lambda r: (V.money(r, 1.0, 10000.0, 12, 2, S, "t", "money") * 100).cast("long"), f"greatest(100, least(1000000, {_CENTS}))")
_values("gen_bool", lambda r: V.boolean(r, 0.85, S, "t", "bool"), f"{uniform_sql(R, S, 't', 'bool')} < 0.85")
_H = f"md5(concat_ws('|', '{S}', 't', 'uuid', CAST({R} AS VARCHAR)))"
_values("gen_uuid", lambda r: V.uuid4(r, S, "t", "uuid"), f"substr({_H},1,8) || '-' || substr({_H},9,4) || '-4' || substr({_H},14,3) || '-' || substr('89ab', CAST(CAST('0x' || substr({_H},17,1) AS BIGINT) % 4 + 1 AS BIGINT), 1) || substr({_H},18,3) || '-' || substr({_H},21,12)")


def _days_sql(span: int, *parts) -> str:
    b = f"({bits_sql(R, *parts)} >> 2)"
    return f"(((({b} * {b}) >> 30) * {span}) >> 30)"


LO, HI = dt.date(2024, 1, 2), dt.date(2026, 1, 1)
_values("gen_date", lambda r: V.date(r, LO, HI, S, "t", "date"), f"DATE '{HI}' - CAST({_days_sql((HI - LO).days, S, 't', 'date')} AS INTEGER)")


def _hour_sql() -> str:
    r, total, out = below_sql(sum(V.HOUR_WEIGHTS), R, S, "t", "ts", "hour"), 0, []
    for h, w in enumerate(V.HOUR_WEIGHTS[:-1]):
        total += w
        out.append(f"WHEN {r} < {total} THEN {h}")
    return f"CASE {' '.join(out)} ELSE 23 END"


_D1, _D2 = (f"(DATE '{HI}' - CAST({_days_sql((HI - LO).days, S, 't', 'ts', salt)} AS INTEGER))" for salt in ("day", "again"))
_DAY = f"CASE WHEN isodow({_D1}) >= 6 AND {uniform_sql(R, S, 't', 'ts', 'weekend')} < 0.6 THEN {_D2} ELSE {_D1} END"
_values("gen_timestamp", lambda r: V.timestamp(r, dt.datetime.combine(LO, dt.time()), dt.datetime.combine(HI, dt.time()), S, "t", "ts"), f"least(TIMESTAMP '{HI}', greatest(TIMESTAMP '{LO}', CAST({_DAY} AS TIMESTAMP) + to_seconds(CAST({_hour_sql()} * 3600 + {below_sql(3600, R, S, 't', 'ts', 'second')} AS BIGINT))))")
_values("gen_enum", lambda r: V.choice(r, ["red", "green", "blue"], S, "t", "enum"), f"(['red','green','blue'])[CAST({below_sql(3, R, S, 't', 'enum')} + 1 AS INTEGER)]")
_W = below_sql(10, R, S, "t", "weighted")
_values("gen_enum_weighted", lambda r: V.weighted(r, ["free", "pro", "team"], [7, 2, 1], S, "t", "weighted"), f"CASE WHEN {_W} < 7 THEN 'free' WHEN {_W} < 9 THEN 'pro' ELSE 'team' END")


def _list_sql(values: list[str]) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def _pick_sql(name: str, salt: str, column: str) -> str:
    return f"({_list_sql(V.WORDS[name])})[CAST({below_sql(len(V.WORDS[name]), R, S, 't', column, salt)} + 1 AS INTEGER)]"


_values("gen_text", lambda r: V.text(r, "email", 30, S, "t", "email"), f"substr(lower({_pick_sql('first_name', 'a', 'email')}) || '.' || lower({_pick_sql('last_name', 'b', 'email')}) || CAST({below_sql(10000, R, S, 't', 'email', 'n')} AS VARCHAR) || '@example.com', 1, 30)")
_B36 = "substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(({r} // {p}) % 36 + 1 AS BIGINT), 1)"
_TAIL = "ltrim(" + " || ".join(_B36.format(r=f'({R} + 1)', p=36**k) for k in range(5, -1, -1)) + ", '0')"
_CITY = _pick_sql("city", "a", "city")
_values("gen_unique", lambda r: V.unique_text(V.text(r, "city", 9, S, "t", "city"), r + 1, 9), f"substr(substr({_CITY}, 1, 9), 1, CAST(greatest(0, 9 - length('-' || {_TAIL})) AS BIGINT)) || '-' || {_TAIL}")
_values("check_derive_dependent", lambda r: V.derived(V.date(r, LO, HI, S, "t", "date"), ">", r, "date", S, "t", "until"), f"CAST(DATE '{HI}' - CAST({_days_sql((HI - LO).days, S, 't', 'date')} AS INTEGER) + CAST({below_sql(90, R, S, 't', 'until', 'away')} + 1 AS INTEGER) AS DATE)")


_TRY = "(o_orderkey || '/' || t)"


@query(f"SELECT o_orderkey AS rid, min(t) AS tries, arg_min(v, t) AS value FROM (SELECT o_orderkey, t, 1 + {below_sql(1000, _TRY, S, 't', 'score')} AS v FROM orders, range(51) r(t)) WHERE v % 7 = 3 GROUP BY 1")
def check_filter_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of 51 draws for which value % 7 = 3; orders without one are left out."""

    def draw(attempt: Column) -> Column:
        value = V.integer(F.concat_ws("/", F.col("rid").cast("string"), attempt.cast("string")), 1, 1000, S, "t", "score")
        return F.struct(attempt.cast("long").alias("tries"), value.alias("value"))

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"))
    return first_that_holds(rows, draw(F.lit(0)), draw, lambda d: f"{d}.value % 7 = 3", "w").filter("w is not null").select("rid", "w.tries", "w.value")


CHAIN = "CREATE TABLE t (lo INT CHECK (LO >= 10), mid INT, hi INT CHECK (hi <= 600), CHECK (lo < mid AND mid < hi), CHECK (lo + 5 <= hi))"
_LO, _MID = (below_sql(n, R, S, "t", c, "away") for n, c in (("(last - first + 1)", "lo"), ("(last - first + 1)", "mid")))


@query(
    f"""WITH h AS (SELECT o_orderkey, 15 + {below_sql(586, R, S, 't', 'hi')} AS hi FROM orders),
 l AS (SELECT o_orderkey, hi, first + {_LO} AS lo FROM (SELECT *, greatest(10, hi - 5 - 89) AS first, hi - 5 AS last FROM h)),
 m AS (SELECT o_orderkey, hi, lo, first + {_MID} AS mid FROM (SELECT *, lo + 1 AS first, least(hi - 1, lo + 90) AS last FROM l))
 SELECT o_orderkey AS rid, lo, mid, hi FROM m"""
)
def check_bounded_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns that are bounded and compared in a chain, for each order."""
    t = parse_ddl(CHAIN)["t"]
    (system,) = systems(t, [], {})
    steps = Steps(_children(spark, sf_dir))

    def own(c: str, limits: tuple) -> Column:
        return V.integer(F.col("rid"), int(limits[0]), int(limits[1]), S, "t", c)

    made = draw(system, {}, own, set(), F.col("rid"), steps, dict, S, "t")
    return steps.rows.select("rid", *[made[c].cast("long").alias(c) for c in ("lo", "mid", "hi")])


# foreign keys: customers and suppliers as parents of orders

_CUSTOMERS = "cust AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) AS rid FROM customer)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by row number: their keys are 0, 1, 2 ..."""
    key = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(key.alias("key"), (key + 1).alias("rid"))


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"))


@query(f"WITH {_CUSTOMERS} SELECT o_orderkey AS rid, key AS parent FROM orders JOIN cust ON cust.rid = {below_sql('(SELECT count(*) FROM customer)', R, S, 'o', 'uniform')} + 1")
def fk_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = _customers(spark, sf_dir)
    picked = _children(spark, sf_dir).withColumn("pick", K.uniform_pick(parents.count(), F.col("rid"), S, "o", "uniform"))
    return picked.join(parents.select(F.col("rid").alias("pick"), F.col("key").alias("parent")), "pick").select("rid", "parent")


_ZIPF = f"""WITH {_CUSTOMERS}, {permute_sql('places', '(SELECT count(*) FROM customer)', S, 'o', 'zipf', 'rank')}, ranked AS (SELECT key, j + 1 AS r FROM cust JOIN places ON i = rid - 1),
 w AS (SELECT key, r, CAST(greatest(1, floor(1e6 * pow(CAST(r AS DOUBLE), -0.7))) AS BIGINT) AS w FROM ranked),
 s AS (SELECT key, CAST(sum(w) OVER (ORDER BY r) AS BIGINT) AS hi, w FROM w), c AS (SELECT o_orderkey AS rid, {below_sql('(SELECT max(hi) FROM s)', R, S, 'o', 'zipf')} AS x FROM orders)
 SELECT c.rid, s.key AS parent FROM c JOIN s ON x < hi AND x >= hi - w"""


@query(_ZIPF)
def fk_zipfian(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = _customers(spark, sf_dir)
    picked = K.zipf_pick(_children(spark, sf_dir), table(spark, sf_dir, "customer").count(), S, "o", "zipf")
    return picked.join(parents.select(F.col("rid").alias("pick"), F.col("key").alias("parent")), "pick").select("rid", "parent")


_ALLOCATED = f"""WITH {_CUSTOMERS}, k AS (SELECT key, rid AS pick, CAST(2 + {below_sql(4, 'rid', S, 'fanout', 'o')} AS BIGINT) AS k FROM cust),
 b AS (SELECT key, k, sum(k) OVER (ORDER BY pick) - k AS before FROM k), e AS (SELECT key, before, unnest(range(1, k + 1)) AS place FROM b), {permute_sql('places', '(SELECT sum(k) FROM k)', S, 'o', 'alloc', 'order')}
 SELECT j + 1 AS rid, key AS parent, place FROM e JOIN places ON i = before + place - 1"""


@query(_ALLOCATED)
def fk_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 to 5 children for each customer."""
    parents = _customers(spark, sf_dir)
    made, _ = K.allocate(spark, table(spark, sf_dir, "customer").count(), lambda rid: Fanout(2, 5, "customer").children(rid, S, "o"), S, "o", "alloc")
    return made.join(parents.select(F.col("rid").alias("pick"), F.col("key").alias("parent")), "pick").select("rid", "parent", F.col("place").cast("long").alias("place"))


@query(f"SELECT s_suppkey AS rid, n_nationkey, n_regionkey FROM supplier JOIN (SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) ON r = {below_sql('(SELECT count(*) FROM nation)', 's_suppkey', S, 's', 'pair')} + 1")
def fk_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation and its region for each supplier, from one row of nation."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    ranked = number_rows(nations, row_buckets(F.col("n_nationkey")), [F.col("n_nationkey")], "pick")
    picked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rid")).withColumn("pick", K.uniform_pick(ranked.count(), F.col("rid"), S, "s", "pair"))
    return picked.join(ranked, "pick").select("rid", "n_nationkey", "n_regionkey")


@query(f"WITH {_CUSTOMERS} SELECT o_orderkey AS rid, CASE WHEN {uniform_sql(R, S, 'o', 'uniform', 'null')} >= 0.1 THEN key END AS parent FROM orders JOIN cust ON cust.rid = {below_sql('(SELECT count(*) FROM customer)', R, S, 'o', 'uniform')} + 1")
def fk_null_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fk_uniform(spark, sf_dir)
    return made.select("rid", V.nullable(F.col("parent"), 0.1, F.col("rid"), S, "o", "uniform").alias("parent"))


def _multiplier_sql(n: str) -> str:
    """The least number from 0.618 n on that has no factor with n."""
    return f"(SELECT min(a) FROM (SELECT CAST(floor({n} * CAST(0.6180339887 AS DOUBLE)) AS BIGINT) + i AS a FROM range(64) t(i)) WHERE gcd(a, {n}) = 1)"


_CELLS = "(SELECT (SELECT count(*) FROM supplier) * (SELECT count(*) FROM part))"


@query(f"WITH {permute_sql('cells', _CELLS, S, 'j')} SELECT o_orderkey AS rid, j // (SELECT count(*) FROM part) + 1 AS supplier, j % (SELECT count(*) FROM part) + 1 AS part FROM orders JOIN cells ON i = o_orderkey")
def junction_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A different pair of supplier and part for each order."""
    sizes = [table(spark, sf_dir, t).count() for t in ("supplier", "part")]
    orders = _children(spark, sf_dir)
    first, second = K.cells(sizes, orders.count(), F.col("rid") + 1, S, "j")
    return orders.select("rid", first.alias("supplier"), second.alias("part"))


_P = "(SELECT count(*) FROM part)"


@query(f"WITH e AS (SELECT parent, place FROM ({_ALLOCATED})) SELECT parent, place, (place * {_multiplier_sql(_P)} + {below_sql(_P, 'parent', S, 'j', 'part')}) % {_P} + 1 AS part FROM e")
def junction_allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 to 5 different parts for each customer."""
    n = table(spark, sf_dir, "part").count()
    pairs = fk_allocation(spark, sf_dir).select("parent", "place")
    return pairs.select("parent", "place", (F.pmod(F.col("place") * K.multiplier(n) + below(n, F.col("parent"), S, "j", "part"), F.lit(n)) + 1).cast("long").alias("part"))


@query(f"WITH {_CUSTOMERS}, {permute_sql('places', '(SELECT count(*) FROM customer)', S, 'o', 'rank')} SELECT rid, j + 1 AS rank FROM cust JOIN places ON i = rid - 1")
def fk_rank_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of parents that zipfian weights follow."""
    customers = _customers(spark, sf_dir)
    return customers.select("rid", (K.ranked(customers.count(), S, "o").of(F.col("rid") - 1) + 1).alias("rank"))


# coherence

_ANCHOR_C = "CASE WHEN c_custkey % 9 <> 0 THEN TIMESTAMP '1994-01-01' + to_days(CAST(c_custkey % 1000 AS INTEGER)) END"
_CAP = f"TIMESTAMP '{CAP}'"


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with made-up anchors, one in nine of them null."""
    start = F.lit(dt.datetime(1994, 1, 1)).cast("timestamp_ntz")
    anchor = F.when(F.col("c_custkey") % 9 != 0, C.moment(C.seconds(start) + F.col("c_custkey") % 1000 * 86400))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("rid"), anchor.alias("anchor"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, greatest(o_orderdate, TIMESTAMP '1995-06-01' + to_days(CASE WHEN p_size > 10 THEN CAST(p_size AS INTEGER) END)) AS floor FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_totalprice > 50000 LEFT JOIN part ON p_partkey = l_partkey")
def coherence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later of the anchors of a line's parents; small orders and parts have none."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 50000").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp_ntz").alias("a"))
    start = F.lit(dt.datetime(1995, 6, 1)).cast("timestamp_ntz")
    parts = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), C.moment(C.seconds(start) + F.col("p_size") * 86400).alias("b"))
    joined = lines.join(orders, "l_orderkey", "left").join(parts, "l_partkey", "left")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", C.floor_of([F.col("a"), F.col("b")]).alias("floor"))


_E = "CAST(epoch({}) AS BIGINT)".format
_B30 = f"({bits_sql(R, S, 'o', 'anchor')} >> 2)"
_SPAN = f"({_E(_CAP)} - {_E('f')})"
_NEW = f"CASE WHEN f IS NULL THEN o_orderdate WHEN {_SPAN} > 0 THEN TIMESTAMP '1970-01-01' + to_seconds(greatest({_E(_CAP)} - (((({_B30} * {_B30}) >> 30) * {_SPAN}) >> 30), {_E('f')} + 1)) ELSE TIMESTAMP '1970-01-01' + to_seconds({_E('f')} + 60 + {below_sql(3541, R, S, 'o', 'anchor', 'late')}) END"
_REWRITTEN = f"SELECT o_orderkey AS rid, {_NEW} AS anchor FROM orders LEFT JOIN (SELECT c_custkey, {_ANCHOR_C} AS f FROM customer) ON c_custkey = o_custkey"


@query(_REWRITTEN)
def coherence_anchor_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders moved to after their customers' anchors."""
    parents = _anchors(spark, sf_dir).select(F.col("rid").alias("o_custkey"), F.col("anchor").alias("floor"))
    joined = table(spark, sf_dir, "orders").join(parents, "o_custkey", "left")
    new = C.rewrite_anchor(F.col("o_orderdate").cast("timestamp_ntz"), F.col("floor"), F.lit(CAP).cast("timestamp_ntz"), F.col("o_orderkey"), S, "o", "anchor")
    return joined.select(F.col("o_orderkey").alias("rid"), new.alias("anchor"))


_LEAST = f"least(7776000, {_E(_CAP)} - {_E('o_orderdate')})"


@query(f"SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN {below_sql(100, R, S, 'o', 'updated', 'never')} < 30 OR {_LEAST} <= 0 THEN o_orderdate ELSE TIMESTAMP '1970-01-01' + to_seconds({_E('o_orderdate')} + CAST(floor({uniform_sql(R, S, 'o', 'updated')} * {_LEAST}) AS BIGINT)) END AS updated_at FROM orders")
def coherence_updated_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp_ntz")
    old = F.when(F.col("o_orderkey") % 11 != 0, at)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), C.updated_at(old, at, F.lit(CAP).cast("timestamp_ntz"), F.col("o_orderkey"), S, "o", "updated").alias("updated_at"))


@query(f"SELECT o_orderkey AS rid, TIMESTAMP '1970-01-01' + to_seconds({_E('o_orderdate')} + CAST(floor({uniform_sql(R, S, 'o', 'seen')} * greatest(0, {_E(_CAP)} - {_E('o_orderdate')})) AS BIGINT)) AS last_seen FROM orders")
def coherence_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), C.last_seen(at, at, F.lit(CAP).cast("timestamp_ntz"), F.col("o_orderkey"), S, "o", "seen").alias("last_seen"))


_STATUS = {"F": "Delivered", "O": "pending", "P": "CANCELLED"}


def _status():
    status = None
    for k, v in _STATUS.items():
        status = (F.when(F.col("o_orderstatus") == k, v)) if status is None else status.when(F.col("o_orderstatus") == k, v)
    return F.when(F.col("o_orderkey") % 13 != 0, status)


_STATUS_SQL = "lower(CASE WHEN o_orderkey % 13 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'CANCELLED' END END)"
_FULL = {
    "shipped_at": "CASE WHEN st = 'cancelled' THEN FALSE WHEN st IN ('delivered', 'pending') THEN st = 'delivered' ELSE old END",
    "delivered_at": "CASE WHEN st = 'cancelled' THEN FALSE WHEN st IN ('delivered', 'pending') THEN st = 'delivered' ELSE old END",
    "cancelled_at": "CASE WHEN st = 'cancelled' THEN TRUE WHEN st IN ('delivered', 'pending') THEN FALSE ELSE old END",
}
_GATED = f"SELECT o_orderkey, o_orderdate, old, {', '.join(f'{v} AS f_{k}' for k, v in _FULL.items())} FROM (SELECT *, {_STATUS_SQL} AS st, o_orderkey % 2 = 0 AS old FROM orders)"


@query("SELECT o_orderkey AS rid, f_shipped_at AS shipped, f_delivered_at AS delivered, f_cancelled_at AS cancelled FROM (" + _GATED + ")")
def coherence_status_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stages of an order's life cycle its status fills; half of the orders without a status have old values."""
    old = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), *[C.filled(_status(), old, s).alias(s) for s in ("shipped", "delivered", "cancelled")])


def _chain_sql() -> str:
    before, out = _E("o_orderdate"), []
    for c in _FULL:
        at = f"({before} + 7200 + {below_sql(345600 - 7200 + 1, R, S, 'o', c)})"
        out.append(f"CASE WHEN f_{c} THEN TIMESTAMP '1970-01-01' + to_seconds({at}) END AS {c}")
        before = f"(CASE WHEN f_{c} THEN {at} ELSE {before} END)"
    return ", ".join(out)


@query(f"SELECT o_orderkey AS rid, {_chain_sql()} FROM ({_GATED})")
def coherence_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the stages that are filled, one after another."""
    old, names = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")), ["shipped_at", "delivered_at", "cancelled_at"]
    stages = [(n, old, C.filled(_status(), old, n.removesuffix("_at"))) for n in names]
    times = C.lifecycle(F.col("o_orderdate").cast("timestamp_ntz"), stages, F.col("o_orderkey"), S, "o")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), *[t.alias(n) for n, t in zip(names, times, strict=True)])


_A = f"a AS (SELECT c_custkey AS rid, {_ANCHOR_C} AS anchor FROM customer)"


@query(f"WITH {_A}, s AS (SELECT rid, row_number() OVER (ORDER BY rid) AS p FROM a WHERE anchor IS NOT NULL), t AS (SELECT anchor, row_number() OVER (ORDER BY anchor, rid) AS p FROM a WHERE anchor IS NOT NULL) SELECT rid, anchor FROM s JOIN t USING (p) UNION ALL SELECT rid, anchor FROM a WHERE anchor IS NULL")
def coherence_self_ref_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sort_anchors(_anchors(spark, sf_dir))


_FOREST = f"""WITH {_A}, r AS (SELECT rid, anchor, row_number() OVER (ORDER BY coalesce(anchor, TIMESTAMP '1970-01-01'), rid) AS k FROM a)
 SELECT c.rid, p.rid AS parent FROM r c LEFT JOIN r p ON p.k = CASE WHEN {uniform_sql('c.rid', S, 'c', 'root')} >= 0.2 AND c.k > 1 THEN {below_sql('(c.k - 1)', 'c.rid', S, 'c')} + 1 END"""


@query(_FOREST)
def hierarchy_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent among the older customers, or none."""
    rows = _anchors(spark, sf_dir).withColumn("anchor", F.coalesce("anchor", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz")))
    return K.forest_parents(rows, 0.2, S, "c").select("rid", "parent")


_BACK = f"""WITH {_A}, p AS (SELECT rid AS pick, anchor, row_number() OVER (ORDER BY anchor, rid) AS k FROM a WHERE anchor IS NOT NULL),
 c AS (SELECT s_suppkey AS rid, TIMESTAMP '1994-01-01' + to_days(CAST((s_suppkey * 7) % 900 - 20 AS INTEGER)) AS anchor FROM supplier), n AS (SELECT c.rid, (SELECT count(*) FROM p WHERE p.anchor <= c.anchor) AS n FROM c)
 SELECT n.rid, p.pick FROM n LEFT JOIN p ON p.k = CASE WHEN n.n > 0 AND {uniform_sql('n.rid', S, 'b', 'null')} >= 0.2 THEN {below_sql('n.n', 'n.rid', S, 'b')} + 1 END"""


@query(_BACK)
def deferred_fk_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer that is not later than the supplier, if there is one."""
    start = F.lit(dt.datetime(1994, 1, 1)).cast("timestamp_ntz")
    key = F.col("s_suppkey").cast("long")
    children = table(spark, sf_dir, "supplier").select(key.alias("rid"), C.moment(C.seconds(start) + (F.pmod(key * 7, F.lit(900)) - 20) * 86400).alias("anchor"))
    return K.earlier_pick(children, _anchors(spark, sf_dir), 0.2, S, "b").select("rid", "pick")


# pools


def _pool(name: str, fields: list[str], price: bool = False) -> None:
    pool = next(p for p in load_pools() if p.name == name)
    n = len(pool.records)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        record = F.element_at(pool.as_array(), (below(n, F.col("o_orderkey"), S, "t", "pool", name) + 1).cast("int"))
        extra = []
        if price:
            lo, hi = record.getField("price_min").cast("long"), record.getField("price_max").cast("long")
            extra = [(lo + below(hi - lo + 1, F.col("o_orderkey"), S, "t", "pool", name, "price")).alias("price")]
        return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), *[record.getField(f).alias(f) for f in fields], *extra)

    rows = ", ".join("(" + ", ".join([str(i + 1), *["'" + str(r.get(f)).replace("'", "''") + "'" for f in fields], *([str(r["price_min"]), str(r["price_max"])] if price else [])]) + ")" for i, r in enumerate(pool.records))
    names = ", ".join(["i", *fields, *(["lo", "hi"] if price else [])])
    extra = f", lo + {below_sql('(hi - lo + 1)', R, S, 't', 'pool', name, 'price')} AS price" if price else ""
    QUERIES[f"pool_{name}"] = run
    SQL[f"pool_{name}"] = f"SELECT o_orderkey AS rid, {', '.join(fields)}{extra} FROM orders JOIN (VALUES {rows}) p({names}) ON i = {below_sql(n, R, S, 't', 'pool', name)} + 1"


_pool("geo", ["city", "state", "country", "zipcode"])
_pool("person", ["first_name", "gender"])
_pool("products", ["product_name", "category", "tier"], price=True)

# row counts

SMALL = """CREATE TABLE categories (id SERIAL PRIMARY KEY); CREATE TABLE users (id SERIAL PRIMARY KEY); CREATE TABLE employees (id SERIAL PRIMARY KEY, manager_id INT REFERENCES employees(id));
CREATE TABLE products (id SERIAL PRIMARY KEY, category_id INT REFERENCES categories(id)); CREATE TABLE orders (id SERIAL PRIMARY KEY, user_id INT NOT NULL REFERENCES users(id));
CREATE TABLE order_items (order_id INT REFERENCES orders(id), product_id INT REFERENCES products(id), PRIMARY KEY (order_id, product_id));"""


@query(f"SELECT c_nationkey, count(*) AS parents, CAST(sum(2 + {below_sql(4, 'c_custkey', S, 'fanout', 'o')}) AS BIGINT) AS children FROM customer GROUP BY c_nationkey")
def rows_fanout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many children a fan-out of 2 to 5 gives, by nation."""
    k = Fanout(2, 5, "customer").children(F.col("c_custkey"), S, "o").cast("long")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("parents"), F.sum(k).alias("children"))


def _counts(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(counts.items()), "name string, n long")


_PLANNED = "SELECT name, CAST(k * (SELECT count(*) FROM customer) AS BIGINT) AS n FROM (VALUES ('categories', 1), ('users', 1), ('employees', 1), ('products', 3), ('orders', 3), ('order_items', 9)) t(name, k)"


@query(_PLANNED)
def rows_integer_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a schema's tables with as many users as there are customers."""
    schema = parse_ddl(SMALL)
    return _counts(spark, integer_plan(schema, plan_generation(schema).order, table(spark, sf_dir, "customer").count()))


@query(f"WITH t AS (SELECT name, n, greatest(1, n * 1000 // (SELECT sum(n) FROM ({_PLANNED}))) AS m FROM ({_PLANNED})) SELECT name, CAST(m - CASE WHEN name = 'order_items' THEN greatest(0, (SELECT sum(m) FROM t) - 1000) ELSE 0 END AS BIGINT) AS n FROM t")
def rows_capped_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, scaled to a thousand rows."""
    schema = parse_ddl(SMALL)
    return _counts(spark, capped_plan(integer_plan(schema, plan_generation(schema).order, table(spark, sf_dir, "customer").count())))


# texts by hint


def _texts_sql() -> str:
    """All hints of texts, each drawn for the column of its own name."""

    def part(hint: str, n: int | str, salt: str) -> str:
        return below_sql(n, R, S, "t", hint, salt)

    def pick(words: str, hint: str, salt: str) -> str:
        return _pick_sql(words, salt, hint)

    def capital(x: str) -> str:
        return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"

    number = lambda hint: part(hint, 10000, "n")
    made = {
        "email": f"lower({pick('first_name', 'email', 'a')}) || '.' || lower({pick('last_name', 'email', 'b')}) || {number('email')} || '@example.com'",
        "phone": f"'+1-555-' || lpad(CAST({number('phone')} AS VARCHAR), 4, '0')",
        "full_name": f"{pick('first_name', 'full_name', 'a')} || ' ' || {pick('last_name', 'full_name', 'b')}",
        "street_address": f"({number('street_address')} + 1) || ' ' || {capital(pick('word', 'street_address', 'a'))} || ' Street'",
        "zipcode": f"lpad(CAST({part('zipcode', 100000, 'zip')} AS VARCHAR), 5, '0')",
        "url": f"'https://' || {pick('word', 'url', 'a')} || {number('url')} || '.example.com'",
        "ipv4": "'10.' || " + " || '.' || ".join(part("ipv4", 256, f"o{i}") for i in range(3)),
        "paragraph": f"{capital(pick('word', 'paragraph', 'a'))} || ' ' || concat_ws(' ', {', '.join(pick('word', 'paragraph', f'w{i}') for i in range(8))}) || '.'",
        "money": f"CAST({number('money')} AS VARCHAR)",
        "gender": f"(['female', 'male', 'nonbinary'])[CAST({below_sql(3, R, S, 't', 'gender')} + 1 AS INTEGER)]",
        "tier": f"(['budget', 'mid', 'premium'])[CAST({below_sql(3, R, S, 't', 'tier')} + 1 AS INTEGER)]",
        "category": capital(pick("word", "category", "a")),
        "phrase": f"{capital(pick('word', 'phrase', 'a'))} || ' ' || {pick('word', 'phrase', 'b')} || ' ' || {pick('word', 'phrase', 'c')}",
    } | {h: pick(h, h, "a") for h in ("first_name", "last_name", "city", "state", "country", "company", "job_title")}
    return "SELECT o_orderkey AS rid, " + ", ".join(f"substr({sql}, 1, 40) AS {hint}" for hint, sql in made.items()) + " FROM orders"


HINTED = ("email", "phone", "full_name", "street_address", "zipcode", "url", "ipv4", "paragraph", "money", "gender", "tier", "category", "first_name", "last_name", "city", "state", "country", "company", "job_title", "phrase")


@query(_texts_sql())
def gen_text_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of each hint, and one of none, for each order."""
    rid = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(rid.alias("rid"), *[V.text(rid, h if h != "phrase" else None, 40, S, "t", h).alias(h) for h in HINTED])
