"""Value pools: records whose fields go together, from JSON files; later folders replace pools of the same name."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import number_rows
from ..plans.model import TEXTUAL, Table
from ..storage import materialise

OWN = Path(__file__).parent / "pool_files"


LITERAL = 256  # records that a plan holds as a literal; larger pools are tables
BROADCAST = 32 << 20  # bytes of a table's texts: more are joined by a shuffle


@dataclass
class Pool:
    """records, or rows(record from 0, fields as texts) with how many they are and their bytes."""

    name: str
    match: list[str]
    records: list[dict]
    rows: DataFrame | None = None
    n: int = 0
    size: int = 0

    def __len__(self) -> int:
        return self.n if self.rows is not None else len(self.records)

    @property
    def fields(self) -> set[str]:
        return set(self.rows.columns) - {"record"} if self.rows is not None else set().union(*self.records)

    def as_array(self) -> Column:
        """All records as one literal."""
        names = sorted(self.fields)
        return F.array(*[F.struct(*[F.lit(None if r.get(n) is None else str(r[n])).alias(n) for n in names]) for r in self.records])

    def frame(self, spark: SparkSession) -> DataFrame:
        if self.rows is not None:
            return self.rows
        names = sorted(self.fields)
        return spark.createDataFrame([(i, *[None if r.get(n) is None else str(r[n]) for n in names]) for i, r in enumerate(self.records)], ", ".join(["record long", *[f"{n} string" for n in names]]))

    def add_record(self, rows: DataFrame, at: Column, name: str, fields: list[str]) -> DataFrame:
        """rows with a struct of those fields of the record at that place: from a literal, or by a join on its number, whose table side is
        broadcast only if it is known to be small."""
        if len(self) <= LITERAL and self.rows is None:
            return rows.withColumn(name, F.element_at(self.as_array(), (at + 1).cast("int")))
        table = self.frame(rows.sparkSession).select(F.col("record").alias(f"{name}_at"), F.struct(*[f"`{f}`" for f in fields]).alias(name))
        small = self.size <= BROADCAST if self.rows is not None else True  # records of the driver's own
        return rows.withColumn(f"{name}_at", at).join(F.broadcast(table) if small else table, f"{name}_at", "left").drop(f"{name}_at")


def read_records(spark: SparkSession, name: str, match: list[str], path: str) -> Pool:
    """A pool whose records are a dataset that Spark reads: Parquet, or else JSON lines. They are written once with numbers from 0, in the
    order of that copy."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.json(path)
    fields = sorted(raw.columns)
    copy = materialise(raw.select(F.monotonically_increasing_id().alias("_id"), *[F.col(f"`{f}`").cast("string").alias(f) for f in fields]), f"pool-{name}")
    numbered = number_rows(copy, [F.shiftright("_id", 33), F.shiftright("_id", 13)], [F.col("_id")], "record")
    rows = materialise(numbered.select((F.col("record") - 1).alias("record"), *[f"`{f}`" for f in fields]), f"pool-{name}")
    size = sum((F.coalesce(F.octet_length(F.col(f"`{f}`")), F.lit(0)) for f in fields), F.lit(8).cast("long"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    if not total["n"]:
        raise ValueError(f"{path}: a pool has records")
    return Pool(name, match, [], rows, total["n"], total["size"])


def load_pools(folders: tuple[str, ...] = (), spark: SparkSession | None = None) -> list[Pool]:
    """Pools of the package and of folders. A pool's records are listed in its file, or are the path of a dataset."""
    found: dict[str, Pool] = {}
    for folder in (OWN, *map(Path, folders)):
        for path in sorted(folder.glob("*.json")):
            raw = json.loads(path.read_text())
            records = raw.get("records")
            if not isinstance(records, (list, str)) or not records or not raw.get("name"):
                raise ValueError(f"{path}: a pool has a name and records")
            if isinstance(records, str):
                found[raw["name"]] = read_records(spark or SparkSession.active(), raw["name"], list(raw.get("match", [])), records)
            else:
                found[raw["name"]] = Pool(raw["name"], list(raw.get("match", [])), records)
    return [found[n] for n in sorted(found)]


def pool_groups(table: Table, pools: list[Pool], taken: set[str]) -> list[tuple[Pool, list[tuple[T.StructField, str]]]]:
    """(pool, [(column, field)]): text columns whose hint a pool matches; a column belongs to the first pool. Columns with a
    domain of their own don't take part."""
    out, used = [], set(taken)
    for pool in pools:
        columns = [(c, c.metadata.get("hint")) for c in table.row if c.name not in used and c.metadata.get("hint") in pool.match and c.metadata.get("hint") in pool.fields and c.metadata["sql"] in TEXTUAL and c.metadata.get("domain") is None and not any(f[:2] == ("in", c.name) for k in table.checks for f in k.facts)]
        if columns:
            out.append((pool, columns))
            used |= {c.name for c, _ in columns}
    return out
