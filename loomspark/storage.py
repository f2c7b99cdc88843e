"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a new local folder if the session has no other machine (local[n]), as in tests;
    on a cluster that is an error, as executors would write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in it that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/loomspark/{name}-{uuid.uuid4().hex}"


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialise() writes inside are removed at the end, whatever thread wrote them: for runs whose results are then written
    elsewhere or collected, since lazy results would still read them."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open[:] = [x for x in _open if x is not made]
        for path in made:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Rows of many computed columns become one Java method, and HotSpot compiles none of more than 8000 bytes. Inside, Spark cuts
    what is longer into short methods (it calls 8000 preferable on HotSpot); the session's own setting, if it has one, comes first."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) != "65535":  # Spark's default
        yield
        return
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.unset(name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back: later steps start from files, which outlive executors."""
    path = new_path(df.sparkSession, name)
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a session, unless PYTHONPATH has it."""
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_loomspark_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "loomspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "loomspark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(path))
    context._loomspark_shipped = True
