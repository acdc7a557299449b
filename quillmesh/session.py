"""Session settings that every entry point shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: UTC and ANSI-off arithmetic are part of the results; the rest is sizing and may be overridden.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "quillmesh", cores: int | str | None = None, shuffle_partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's own settings win."""
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for k, v in (BASE_CONF | (extra or {})).items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("QUILLMESH_DRIVER_MEMORY", "8g"))
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables, by Spark's reader only, so any store Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes in one Arrow batch to Python; both bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bounds what one Arrow batch carries to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@contextmanager
def no_broadcasts(spark: SparkSession) -> Iterator[None]:
    """While it holds, joins are not broadcast but where they ask for it; the session's setting comes back after. A driver
    that plans dozens of joins of small tables at once keeps one hash table for each, and Spark takes a
    written table for as large as its compressed files, and an exploded one for as large as what it is made of."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: the cluster's spark.checkpoint.dir, or a local one in local mode (tests).

    Elsewhere an unset one is an error: each executor would write to a disk of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        at = f"file://{tempfile.gettempdir()}/quillmesh-checkpoints"
    return f"{at}/quillmesh"


def file_system(spark: SparkSession, at: str):
    """Hadoop's file system of a path, and the path, for any store that Spark can open."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def materialize(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts lineage: later stages survive lost executors and never
    recompute it. The table is deleted by forget, or else when the application ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(at)
    fs, path = file_system(spark, at)
    fs.deleteOnExit(path)
    back = spark.read.schema(df.schema).parquet(at)
    back._quillmesh_path = at
    return back


def forget(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for t in tables:
        if at := getattr(t, "_quillmesh_path", None):
            fs, path = file_system(t.sparkSession, at)
            fs.delete(path, True)
            fs.cancelDeleteOnExit(path)
