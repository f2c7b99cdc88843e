"""Validation and event statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import uniform, uniform_sql
from ..operators import hierarchy, stats, validate
from ..plans.model import Schema
from ..sources.ddl import parse_ddl

#: What is declared of the tables. Two rules don't hold: lineitem has no key in its order and line, and some names are longer than declared.
DDL = """
CREATE TABLE customer (c_custkey BIGINT PRIMARY KEY, c_name VARCHAR(18) NOT NULL, c_nationkey INT NOT NULL, c_acctbal FLOAT NOT NULL CHECK (c_acctbal > 0), c_mktsegment VARCHAR(9) CHECK (c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')));
CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT NOT NULL REFERENCES customer(c_custkey), o_orderstatus VARCHAR(1) NOT NULL CHECK (o_orderstatus IN ('F', 'O', 'P')), o_totalprice FLOAT CHECK (o_totalprice BETWEEN 1000 AND 400000), o_orderdate TIMESTAMP NOT NULL, o_orderpriority TEXT, CHECK (o_totalprice > o_custkey));
CREATE TABLE lineitem (l_orderkey BIGINT NOT NULL REFERENCES orders(o_orderkey), l_partkey BIGINT NOT NULL, l_suppkey BIGINT NOT NULL, l_linenumber INT NOT NULL, l_quantity FLOAT NOT NULL CHECK (l_quantity < 45), l_extendedprice FLOAT, l_discount FLOAT CHECK (l_discount BETWEEN 0 AND 0.1), l_tax FLOAT, l_returnflag TEXT, l_linestatus TEXT, l_shipdate TIMESTAMP, PRIMARY KEY (l_orderkey, l_linenumber), UNIQUE (l_partkey, l_suppkey, l_linenumber));
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def declared() -> Schema:
    return parse_ddl(DDL)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in declared()}


def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that is declared, with its violations."""
    return validate.validate(tables(spark, sf_dir), declared())


def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(validate_report(spark, sf_dir))


def _of_kind(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema, found = declared(), None
        for name, df in tables(spark, sf_dir).items():
            rows = validate.row_checks(df, schema[name]).filter(F.col("kind") == kind).select(F.lit(name).alias("table"), "name", "violations")
            found = rows if found is None else found.unionByName(rows)
        return found

    return run


def _report_sql(kinds: tuple[str, ...] | None = None) -> str:
    """The rules as SQL, written out one after another."""
    out = []

    def add(t: str, kind: str, name: str, count: str, source: str | None = None) -> None:
        if kinds is None or kind in kinds:
            label = name.replace("'", "''")
            out.append(f"SELECT '{t}' AS \"table\", '{kind}' AS kind, '{label}' AS name, CAST({count} AS BIGINT) AS violations, 'error' AS severity FROM {source or t}")

    def repeats(t: str, columns: list[str]) -> str:
        some = " AND ".join(f"{c} IS NOT NULL" for c in columns)
        return f"(SELECT count(*) AS n FROM {t} WHERE {some} GROUP BY {', '.join(columns)})"

    for t, model in declared().items():
        for c in model.row:
            add(t, "not_null", c.name, f"count(*) FILTER (WHERE {c.name} IS NULL)" if not c.nullable else "0", None if not c.nullable else "(SELECT 1)")
            add(t, "type", c.name, f"count(*) FILTER (WHERE length({c.name}) > {c.metadata.get("length")})" if c.metadata.get("length") else "0", None if c.metadata.get("length") else "(SELECT 1)")
            if c.metadata.get("domain"):
                add(t, "enum", c.name, f"count(*) FILTER (WHERE {c.name} NOT IN ({', '.join(repr(v) for v in c.metadata.get("domain"))}))")
        for check in model.checks:
            add(t, "check", check.sql, f"count(*) FILTER (WHERE NOT ({check.sql}))")
        nulls = " OR ".join(f"{c} IS NULL" for c in model.key)
        add(t, "primary_key", ",".join(model.key), f"coalesce(sum(n - 1), 0) + (SELECT count(*) FROM {t} WHERE {nulls})", repeats(t, model.key))
        for group in model.groups:
            add(t, "unique", ",".join(group), "coalesce(sum(n - 1), 0)", repeats(t, group))
        for fk in model.references:
            c, r = fk.columns[0], fk.to[0]
            add(t, "foreign_key", c, "count(*)", f"{t} WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {fk.table} WHERE {r} = {c})")
    return " UNION ALL ".join(out)


def validate_unique_first_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers who ordered before, with the first order."""
    return stats.first_seen(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


def validate_fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order isn't among the large ones."""
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 100000")
    return validate.orphans(table(spark, sf_dir, "lineitem"), ["l_orderkey"], large, ["o_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def validate_fk_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("audit_orders")
    table(spark, sf_dir, "customer").createOrReplaceTempView("audit_customer")
    return spark.sql("SELECT count(*) AS n FROM audit_orders o WHERE NOT EXISTS (SELECT 1 FROM audit_customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)")


def validate_fk_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.filter("l_quantity > 25").select("l_partkey", "l_suppkey").distinct()
    return validate.orphans(lines, ["l_partkey", "l_suppkey"], pairs, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def validate_child_before_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ship before their order."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return validate.before_parent(lines, ["l_orderkey"], "l_shipdate", orders, ["o_orderkey"], "o_orderdate").agg(F.count("*").alias("n"))


def validate_hierarchy_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers from whom no walk up a made-up hierarchy ends."""
    key = F.col("c_custkey")
    parent = F.when(key % 50 != 0, F.pmod(key * key + 7, F.lit(997)) + 1)
    return hierarchy.unrooted(table(spark, sf_dir, "customer").select("c_custkey", parent.alias("parent")), "c_custkey", "parent")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("target", F.coalesce(F.get_json_object("props", "$.k"), F.lit("unknown")))


def stats_pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_where(table(spark, sf_dir, "events"), F.col("event_type") == "view", "pageviews")


def stats_unique_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").filter("event_type = 'view'").withColumn("session", F.col("user_id").cast("string"))
    return stats.distinct_where(views, "session", "sessions")


def stats_clicks_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ranked_groups(_views(spark, sf_dir).filter("event_type = 'click'"), "target")


def stats_pageviews_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ranked_groups(_views(spark, sf_dir).filter("event_type = 'view'"), "target")


def stats_recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latest(table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "user_id", "event_type")


def stats_zero_filled_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.zero_filled(table(spark, sf_dir, "events"), "event_type", ["view", "click", "refund", "purchase"])


def stats_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer of each normalised address."""
    address = F.concat(F.lower(F.trim("c_mktsegment")), (F.col("c_custkey") % 40).cast("string"), F.lit("@example.com"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", address.alias("email"))
    return stats.first_of_each(rows.filter(stats.valid_email(F.col("email"))), F.col("email"), ["c_custkey"])


def stats_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of events who aren't among the customers with credit."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id")
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return stats.insert_ignore(known, users, "id", ["event_id"])


def rate_limit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hits a day for each user."""
    hits = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"), "event_id")
    return stats.replay_limits(hits, "user_id", "at", "event_id", 2, 86400.0).select("user_id", "event_id", "allowed", "retry_after")


def null_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts, one in five of them null."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.when(uniform(F.col("p_partkey"), 42, "part", "price", "null") >= 0.2, F.col("p_retailprice")).alias("price"))


_LIMIT_SQL = """
WITH RECURSIVE hits AS (
  SELECT user_id, event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS DOUBLE), event_id) AS rn FROM events),
step AS (
  SELECT user_id, event_id, rn, [t] AS kept, TRUE AS allowed, CAST(0 AS BIGINT) AS retry_after FROM hits WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, rn, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END, len(live) < 2,
         CASE WHEN len(live) < 2 THEN CAST(0 AS BIGINT) ELSE CAST(floor(live[1] + 86400 - t) AS BIGINT) + 1 END
  FROM (SELECT h.user_id, h.event_id, h.rn, h.t, list_filter(s.kept, lambda x: x > h.t - 86400) AS live FROM step s JOIN hits h ON h.user_id = s.user_id AND h.rn = s.rn + 1))
SELECT user_id, event_id, allowed, retry_after FROM step
"""
_TARGET = "coalesce(json_extract_string(props, '$.k'), 'unknown')"

QUERIES = {
    f.__name__: f
    for f in (validate_report, validate_summary, validate_unique_first_dup, validate_fk_orphans, validate_fk_not_exists, validate_fk_composite, validate_child_before_parent, validate_hierarchy_cycles, stats_pageviews, stats_unique_sessions, stats_clicks_by_target, stats_pageviews_by_path, stats_recent_topk, stats_zero_filled_domain, stats_dedupe_first, stats_insert_ignore, rate_limit_replay, null_injection)
}
QUERIES |= {f"validate_{k}": _of_kind(k) for k in ("not_null", "type", "enum", "check")}

SQL = {
    "validate_report": _report_sql(),
    "validate_summary": f'SELECT "table", count(*) AS constraints_checked, CAST(sum(violations) AS BIGINT) AS violations, CAST(0 AS BIGINT) AS warnings FROM ({_report_sql()}) GROUP BY "table"',
    **{f"validate_{k}": f'SELECT "table", name, violations FROM ({_report_sql((k,))})' for k in ("not_null", "type", "enum", "check")},
    "validate_unique_first_dup": "SELECT o_orderkey, o_custkey, first_row FROM (SELECT o_orderkey, o_custkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_row FROM orders) WHERE o_orderkey > first_row",
    "validate_fk_orphans": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) GROUP BY l_orderkey",
    "validate_fk_not_exists": "SELECT count(*) AS n FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)",
    "validate_fk_composite": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_quantity > 25 AND p.l_partkey = l.l_partkey AND p.l_suppkey = l.l_suppkey)",
    "validate_child_before_parent": "SELECT count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate",
    "validate_hierarchy_cycles": """WITH RECURSIVE h AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 <> 0 THEN (c_custkey * c_custkey + 7) % 997 + 1 END AS p FROM customer),
        rooted AS (SELECT k FROM h WHERE p IS NULL OR p NOT IN (SELECT k FROM h) UNION SELECT h.k FROM h JOIN rooted r ON h.p = r.k)
        SELECT k AS c_custkey FROM h WHERE k NOT IN (SELECT k FROM rooted)""",
    "stats_pageviews": "SELECT count(*) FILTER (WHERE event_type = 'view') AS pageviews FROM events",
    "stats_unique_sessions": "SELECT count(DISTINCT user_id) AS sessions FROM events WHERE event_type = 'view'",
    "stats_clicks_by_target": f"SELECT {_TARGET} AS target, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY n DESC, target",
    "stats_pageviews_by_path": f"SELECT {_TARGET} AS target, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY n DESC, target",
    "stats_recent_topk": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "stats_zero_filled_domain": "SELECT d.event_type, count(e.event_id) AS n FROM (VALUES ('view'), ('click'), ('refund'), ('purchase')) d(event_type) LEFT JOIN events e ON e.event_type = d.event_type GROUP BY 1",
    "stats_dedupe_first": "SELECT min(c_custkey) AS c_custkey, lower(trim(c_mktsegment)) || CAST(c_custkey % 40 AS VARCHAR) || '@example.com' AS email FROM customer GROUP BY 2",
    "stats_insert_ignore": "SELECT user_id AS id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY user_id",
    "rate_limit_replay": _LIMIT_SQL,
    "null_injection": f"SELECT p_partkey, CASE WHEN {uniform_sql('p_partkey', 42, 'part', 'price', 'null')} >= 0.2 THEN p_retailprice END AS price FROM part",
}
