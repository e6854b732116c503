"""Session helpers: settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Methods above 8000 bytes are never compiled by the JVM; wide projections are then
    # better served by split, compiled projections than by one huge generated loop.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_fallback_dirs: dict[str, str] = {}


_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings every operator assumes (UTC clock, AQE) and ship the package."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    ship_code(spark)
    return spark


def ship_code(spark: SparkSession) -> None:
    """Hand the package to the Python workers, wherever the driver was started from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    handle, archive = tempfile.mkstemp(prefix="tidemark-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def local_session(app: str = "tidemark", cpus: str = "8", memory: str = "16g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return configure(builder.getOrCreate())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none (a local test session) is a folder made on
    this machine; on a cluster an unset folder is an error, because executors
    could not read back what the driver's disk holds.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _fallback_dirs[app]


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def enable_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` write below the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def small_table(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """A table of driver-held facts (edges, bounds, bands) as a local relation.

    Sent as Arrow, so it is planned as a local scan with a known size; meant for rows
    whose number is fixed by the schema or a parameter, never by the data.
    """
    schema = T.StructType.fromDDL(ddl)
    rows = [tuple(r) for r in rows]
    if not rows:
        return spark.createDataFrame([], schema)
    names = schema.fieldNames()
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows])
    return spark.createDataFrame(table.select(names), schema)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a derived table once below the shared folder and read it back.

    Cuts the lineage at a file that survives lost executors, so later uses do not
    repeat the scan it came from.
    """
    return materialise_at(df, purpose)[0]


def materialise_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """As :func:`materialise`, with the path, for tables that are discarded after their last reader."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table made by :func:`materialise_at`."""
    if not path.startswith(scratch_root(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is not below the scratch folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished writes now; it does so only after the driver has collected garbage."""
    spark._jvm.System.gc()
