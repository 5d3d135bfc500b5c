"""Small helpers for intermediate tables; nothing here depends on a particular operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import time
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a counted side may have to be broadcast.
BROADCAST_ROWS = 50_000
_shipped: set[str] = set()
#: Seconds between the garbage collections that written() asks for.
GC_SECONDS = 10
_tables: dict[str, SparkSession] = {}
_collected = [0.0]
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="claimboard-zip-"), f"claimboard_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset, a local session gets a temporary one; on a
    cluster, where executors do not see each other's disks, that would lose rows, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = context_dir.get() if context_dir.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="claimboard-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def collect_shuffles(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect its garbage: Spark then deletes the shuffle files that no plan needs any more."""
    spark.sparkContext._jvm.System.gc()
    _collected[0] = time.monotonic()


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the length of one action."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def tables_made():
    """A list that fills with the paths of the tables that written() makes inside the block, in this thread."""
    paths: list[str] = []
    before = _made.set(paths)
    try:
        yield paths
    finally:
        _made.reset(before)
        if (outer := _made.get()) is not None:
            outer.extend(paths)


def written(df: DataFrame, name: str, partition_by: str | None = None, collect: bool = False) -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared folder and read it back. The table is deleted by drop(),
    or when the process ends.

    The shuffle files behind it are then of no use; Spark deletes them once the driver's JVM collects its garbage,
    which is asked for here now and then because long jobs would otherwise hold all their shuffles on disk at once.
    `collect` asks at once, for tables behind large shuffles."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/claimboard-{name}-{uuid.uuid4().hex}"
    schema, writer = df.schema, df.write.mode("error")
    if partition_by:
        with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "8"):  # few partitions need no sort
            writer.partitionBy(partition_by).parquet(path)
    else:
        writer.parquet(path)
    if not _tables:
        atexit.register(drop_all)
    _tables[path] = spark
    if (made := _made.get()) is not None:
        made.append(path)
    del writer, df
    if collect or time.monotonic() - _collected[0] > GC_SECONDS:
        collect_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def written_paths() -> list[str]:
    """Tables that written() made and nobody dropped yet, oldest first."""
    return list(_tables)


def drop_paths(paths: list[str]) -> None:
    """Delete tables of written(), named by path."""
    for path in paths:
        spark = _tables.pop(path, None)
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended; the folder's owner clears it then
            continue


def paths_of(df: DataFrame) -> list[str]:
    """Tables of written() that `df` reads."""
    files = df.inputFiles()
    return [p for p in _tables if any(p.rpartition("/")[2] in f for f in files)]


def drop(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing yet to be run reads."""
    drop_paths([p for t in tables for p in paths_of(t)])


def drop_parts(table: DataFrame, *parts: str) -> None:
    """Delete the named partitions of a table of written() that nothing yet to be run reads."""
    spark = table.sparkSession
    for path in paths_of(table):
        for part in parts:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_all() -> None:
    drop_paths(list(_tables))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 1-based place of every row in `order`, which must be total. Rows are dealt by ranges of the order and
    numbered inside each; what is summed in one task is one count a range."""
    part, base = f"_{name}_part", f"_{name}_base"
    ranged = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "numbered")
    before = F.sum("count").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    bases = ranged.groupBy(part).count().select(part, F.coalesce(before, F.lit(0)).alias(base))
    place = F.row_number().over(W.partitionBy(part).orderBy(*order)) + F.col(base)
    return ranged.join(F.broadcast(bases), part).withColumn(name, place).drop(part, base)


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join to a written table, broadcast only if its counted rows stay under the bound."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right.hint("merge"), on, how)
