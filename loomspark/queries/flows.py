"""Sinks and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.generate import Generator
from ..operators.validate import summary, validate
from ..plans.config import Config
from ..plans.rows import parse_rows
from ..sinks import files
from ..sources.ddl import parse_ddl
from ..storage import new_path
from ..streaming import events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OBSERVATORY = """
CREATE TABLE sites (id UUID PRIMARY KEY, site_code VARCHAR(12) UNIQUE NOT NULL, title VARCHAR(60) NOT NULL, country VARCHAR(60), city VARCHAR(60), altitude INT NOT NULL CHECK (altitude BETWEEN 0 AND 6000), director_id UUID REFERENCES astronomers(id), created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP);
CREATE TABLE telescopes (id UUID PRIMARY KEY, site_id UUID NOT NULL REFERENCES sites(id), call_sign VARCHAR(10) NOT NULL, aperture NUMERIC(6,3) NOT NULL CHECK (aperture > 0), focal_ratio NUMERIC(4,1) CHECK (focal_ratio >= 1), mount VARCHAR(12) NOT NULL CHECK (mount IN ('altaz', 'equatorial', 'fixed')), created_at TIMESTAMP NOT NULL, UNIQUE (site_id, call_sign));
CREATE TABLE instruments (id SERIAL PRIMARY KEY, telescope_id UUID NOT NULL REFERENCES telescopes(id), product_name VARCHAR(60) NOT NULL, category VARCHAR(30), tier VARCHAR(10), price NUMERIC(10,2) NOT NULL CHECK (price > 0), low_nm INT NOT NULL CHECK (low_nm >= 100), high_nm INT NOT NULL, created_at TIMESTAMP NOT NULL, CHECK (high_nm > low_nm));
CREATE TABLE astronomers (id UUID PRIMARY KEY, home_site UUID NOT NULL REFERENCES sites(id), email VARCHAR(120) UNIQUE NOT NULL, full_name VARCHAR(60), first_name VARCHAR(20), gender VARCHAR(10), mentor_id UUID REFERENCES astronomers(id), created_at TIMESTAMP NOT NULL, last_login TIMESTAMP);
CREATE TABLE proposals (id UUID PRIMARY KEY, lead_id UUID NOT NULL REFERENCES astronomers(id), title VARCHAR(80) NOT NULL, status VARCHAR(10) NOT NULL CHECK (status IN ('draft', 'approved', 'completed', 'cancelled')), hours NUMERIC(6,1) NOT NULL CHECK (hours > 0), created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP, approved_at TIMESTAMP, completed_at TIMESTAMP, cancelled_at TIMESTAMP);
CREATE TABLE targets (id BIGSERIAL PRIMARY KEY, catalogue_name VARCHAR(20) UNIQUE NOT NULL, right_ascension NUMERIC(9,5) NOT NULL CHECK (right_ascension BETWEEN 0 AND 359), declination NUMERIC(8,5) NOT NULL CHECK (declination BETWEEN -90 AND 90), magnitude FLOAT CHECK (magnitude < 30), redshift NUMERIC(6,4) CHECK (redshift >= 0), description TEXT, is_active BOOLEAN NOT NULL);
CREATE TABLE nights (id SERIAL PRIMARY KEY, telescope_id UUID NOT NULL REFERENCES telescopes(id), night_of DATE NOT NULL CHECK (night_of BETWEEN '2024-01-01' AND '2025-12-31'), seeing NUMERIC(4,2) CHECK (seeing > 0), humidity INT CHECK (humidity BETWEEN 0 AND 100), observer_id UUID REFERENCES astronomers(id), moonlit BOOLEAN);
CREATE TABLE sessions (id UUID PRIMARY KEY, night_id INT NOT NULL REFERENCES nights(id), proposal_id UUID NOT NULL REFERENCES proposals(id), first_minute INT NOT NULL CHECK (first_minute >= 0), last_minute INT NOT NULL, created_at TIMESTAMP NOT NULL, archived_at TIMESTAMP, CHECK (last_minute > first_minute));
CREATE TABLE exposures (id UUID PRIMARY KEY, session_id UUID NOT NULL REFERENCES sessions(id), target_id BIGINT NOT NULL REFERENCES targets(id), instrument_id INT NOT NULL REFERENCES instruments(id), seconds INT NOT NULL CHECK (seconds > 0), gain SMALLINT CHECK (gain IN (1, 2, 4, 8)), frames INT CHECK (frames % 3 = 0), file_url VARCHAR(200), created_at TIMESTAMP NOT NULL, is_deleted BOOLEAN);
CREATE TABLE calibrations (id SERIAL PRIMARY KEY, instrument_id INT NOT NULL REFERENCES instruments(id), kind VARCHAR(8) NOT NULL CHECK (kind IN ('bias', 'dark', 'flat', 'arc')), valid_from DATE NOT NULL CHECK (valid_from >= '2024-01-01'), valid_until DATE NOT NULL CHECK (valid_until BETWEEN '2024-01-01' AND '2026-12-31'), residual NUMERIC(6,4) CHECK (residual >= 0));
CREATE TABLE reductions (id UUID PRIMARY KEY, exposure_id UUID NOT NULL REFERENCES exposures(id), calibration_id INT REFERENCES calibrations(id), software_version VARCHAR(16) NOT NULL, status VARCHAR(10) NOT NULL CHECK (status IN ('pending', 'processing', 'published', 'archived')), signal_noise FLOAT CHECK (signal_noise > 0), created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP, published_at TIMESTAMP, archived_at TIMESTAMP);
CREATE TABLE papers (id SERIAL PRIMARY KEY, doi VARCHAR(40) UNIQUE NOT NULL, title VARCHAR(100) NOT NULL, summary TEXT, lead_id UUID NOT NULL REFERENCES astronomers(id), citations INT NOT NULL CHECK (citations >= 0), created_at TIMESTAMP NOT NULL, published_at TIMESTAMP);
CREATE TABLE authorships (paper_id INT NOT NULL REFERENCES papers(id), astronomer_id UUID NOT NULL REFERENCES astronomers(id), place SMALLINT NOT NULL CHECK (place BETWEEN 1 AND 50), PRIMARY KEY (paper_id, astronomer_id));
CREATE TABLE repairs (id BIGSERIAL PRIMARY KEY, telescope_id UUID NOT NULL REFERENCES telescopes(id), technician_id UUID REFERENCES astronomers(id), cost NUMERIC(9,2) NOT NULL CHECK (cost >= 0), downtime_hours INT NOT NULL CHECK (downtime_hours BETWEEN 1 AND 720), notes TEXT, created_at TIMESTAMP NOT NULL, resolved_at TIMESTAMP);
CREATE TABLE teams (id SERIAL PRIMARY KEY, proposal_id UUID NOT NULL REFERENCES proposals(id), contact_id UUID REFERENCES astronomers(id), motto VARCHAR(40) UNIQUE NOT NULL, seats INT CHECK (seats BETWEEN 1 AND 60), created_at TIMESTAMP NOT NULL);
"""
OBSERVATORY_ROWS = {"sites": 5, "telescopes": 20, "instruments": 60, "astronomers": 200, "proposals": "1..2 per astronomers", "targets": 300, "nights": 100, "sessions": "1..2 per nights", "exposures": "2..4 per sessions", "calibrations": 150, "reductions": "1..2 per exposures", "papers": 100, "authorships": "1..3 per papers", "repairs": 120, "teams": 230}
#: Rules of each table: two a column (nulls and type), and one a domain, CHECK, key and reference.
OBSERVATORY_RULES = {"sites": 22, "telescopes": 20, "instruments": 23, "astronomers": 22, "proposals": 24, "targets": 22, "nights": 20, "sessions": 19, "exposures": 27, "calibrations": 18, "reductions": 25, "papers": 20, "authorships": 10, "repairs": 21, "teams": 17}


def observatory(spark: SparkSession, scale: int = 1) -> Generator:
    """Of a schema with a cycle, chains, a hierarchy, a junction, life cycles, pools and checks of all forms; about 3,060 rows at scale 1."""
    counts = {t: n * scale if isinstance(n, int) else n for t, n in OBSERVATORY_ROWS.items()}
    return Generator(spark, parse_ddl(OBSERVATORY), {t: parse_rows(n) for t, n in counts.items()}, Config())


_VALUES = "'(' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ')'"


@query(f"SELECT CAST(n_nationkey // 10 AS BIGINT) AS batch, 'INSERT INTO \"nation\" (\"n_nationkey\", \"n_name\", \"n_regionkey\") VALUES' || chr(10) || string_agg({_VALUES}, ',' || chr(10) ORDER BY n_nationkey) || ';' AS statement FROM nation GROUP BY 1")
def sink_sql_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as INSERT statements of ten rows."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").withColumn("_rid", F.col("n_nationkey") + 1)
    return files.insert_statements(rows, "nation", "_rid", 10)


_CSV = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(f"SELECT c_custkey, c_custkey || ',' || coalesce({_CSV.format('c_name')}, '') || ',' || c_nationkey || ',' || coalesce({_CSV.format('seg')}, '') AS line FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN c_mktsegment || ', \"x\"' ELSE c_mktsegment END AS seg FROM customer)")
def sink_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of CSV, some with quotes and some with nulls."""
    seg = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 5 == 1, F.concat("c_mktsegment", F.lit(', "x"'))).otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", seg.alias("seg"))
    return rows.select("c_custkey", files.csv_line(rows).alias("line"))


def _cut(c: str) -> str:
    return f"CASE WHEN length({c}) > 12 THEN substr({c}, 1, 11) || '…' ELSE {c} END"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, {_cut('p_name')} AS p_name, {_cut('p_type')} AS p_type FROM part ORDER BY part.p_partkey LIMIT 10")
def sink_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.preview(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), ["p_partkey"], width=12)


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS place, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS row FROM nation ORDER BY n_nationkey LIMIT 10")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.json_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@query("SELECT r_regionkey, r_name FROM region")
def sink_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as written to CSV files and read again."""
    regions = table(spark, sf_dir, "region")
    (path,) = files.write_csv({"region": regions}, ["region"], new_path(spark, "csv"))
    return spark.read.schema(regions.schema).option("header", True).csv(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    one = spark.read.parquet(path)
    copy = new_path(spark, "events")  # a stream reads a folder
    one.write.parquet(copy)
    return events.event_stream(spark, copy, one.schema)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour, as a stream keeps them."""
    counted = events.window_counts(_events(spark, sf_dir)).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
    return events.run_available(counted, "counts", "complete")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as they first appear in ten years; users are forgotten after that."""
    seen = events.deduplicated(_events(spark, sf_dir), ["user_id"], "3650 days").select("user_id")
    return events.run_available(seen, "seen")


@query(f"SELECT name AS \"table\", CAST(rules AS BIGINT) AS constraints_checked, CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS warnings FROM (VALUES {', '.join(f"('{t}', {n})" for t, n in OBSERVATORY_RULES.items())}) v(name, rules)")
def generated_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema of 15 tables, generated in proportion to the customers and validated; the SQL has the rules as counted by hand and no violation."""
    scale = max(1, table(spark, sf_dir, "customer").count() // 150)
    tables = observatory(spark, scale).run()
    return summary(validate(tables, parse_ddl(OBSERVATORY)))
