"""A watched folder as a stream: changes that have come to rest, deletions, and an index that follows them.

Events are rows of path, content, mtime (double) and gone. settled() keeps each path's last event in state with a timer and
hands it on when nothing more has come for a while. follow() writes each micro-batch's rows and removals; index_now() is
what they come to; compact() folds the batches so far into one table, so reading does not grow with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import file_system
from ..sources.files import read_state, write_state

#: Fixed value: milliseconds without a further change after which one counts.
QUIET_MS = 300
EVENTS = "path string, content string, mtime double, gone boolean"


def listing_events(before: DataFrame, now: DataFrame) -> DataFrame:
    """EVENTS between two looks at a folder (path, content, mtime): new and changed files, and files that are gone."""
    b = before.select("path", F.col("mtime").alias("_m"), F.col("content").alias("_c"))
    both = b.join(now.select("path", "content", "mtime", F.lit(True).alias("_here")), "path", "full_outer")
    gone = F.col("_here").isNull()
    differs = gone | ~F.col("_m").eqNullSafe(F.col("mtime")) | ~F.col("_c").eqNullSafe(F.col("content"))
    return both.filter(differs).select("path", "content", F.coalesce("mtime", "_m").cast("double").alias("mtime"), gone.alias("gone"))


class Debounce(StatefulProcessor):
    """Keeps a path's last event; each further one puts off its timer."""

    def __init__(self, quiet: int = QUIET_MS):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "content string, mtime double, gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        for b in rows:
            for content, mtime, gone in zip(b["content"], b["mtime"], b["gone"], strict=True):
                if held is None or mtime >= held[1]:
                    held = (content, float(mtime), bool(gone))
        if held is not None:
            self.last.update(held)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            content, mtime, gone = self.last.get()
            self.last.clear()
            yield pd.DataFrame({"path": [key[0]], "content": [content], "mtime": [mtime], "gone": [gone]}).astype({"content": object})

    def close(self) -> None:
        pass


def settled(events: DataFrame, quiet: int = QUIET_MS) -> DataFrame:
    """The last event of each path, `quiet` milliseconds after it; of equal times the one that comes later. Events without a
    path are left out. State and timers are Spark's, so a restart from the checkpoint goes on where it was; the session
    needs the RocksDB state store (see configure)."""
    some = events.filter("path is not null and mtime is not null").select("path", "content", "mtime", F.coalesce("gone", F.lit(False)).alias("gone"))
    return some.groupBy("path").transformWithStateInPandas(Debounce(quiet), EVENTS, "Append", "ProcessingTime")


def configure(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def follow(changes: DataFrame, root: str, checkpoint: str, make_rows: Callable[[DataFrame], DataFrame], trigger: dict | None = None):
    """Starts a query that keeps an index under root current with a stream of EVENTS.

    A micro-batch writes the rows of its paths, made by make_rows (which keeps path), and the paths themselves, whether gone
    or not, under batch=<id>, overwriting that folder, so one that is run again leaves the same.
    """

    def write(batch: DataFrame, n: int) -> None:
        newest = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("content"))
        last = batch.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r").persist()
        try:
            if last.isEmpty():
                return
            make_rows(last.filter("not gone")).write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
            last.select("path", "gone").write.mode("overwrite").parquet(f"{root}/paths/batch={n}")
        finally:
            last.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "200 milliseconds"})).start()


def _batches(spark: SparkSession, root: str, after: int) -> list[int]:
    """Numbers of the batches above one that are whole: their paths, written last, are there."""
    fs, at = file_system(spark, f"{root}/paths")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
    return [n for n in numbers if n > after and fs.exists(file_system(spark, f"{root}/paths/batch={n}/_SUCCESS")[1])]


def _folded(spark: SparkSession, root: str) -> tuple[DataFrame | None, int]:
    """The compacted table and the last batch in it; None and -1 without one."""
    base = read_state(spark, f"{root}/base")
    upto = base.agg(F.max("batch")).first()[0] if base is not None else None
    return (base, upto) if upto is not None else (None, -1)


def index_now(spark: SparkSession, root: str) -> DataFrame | None:
    """The index rows of every path's newest batch, paths that are gone left out; None before anything was written."""
    base, upto = _folded(spark, root)
    later = _batches(spark, root, upto)
    rows = base.filter("path is not null").drop("batch") if base is not None else None
    if not later:
        return rows
    read = lambda what: spark.read.option("basePath", f"{root}/{what}").parquet(*[f"{root}/{what}/batch={n}" for n in later])
    newest = read("paths").groupBy("path").agg(F.max("batch").alias("batch"))
    fresh = read("rows").join(newest, ["path", "batch"], "left_semi").drop("batch")
    if rows is None:
        return fresh
    return rows.join(newest, "path", "left_anti").unionByName(fresh)


def compact(spark: SparkSession, root: str) -> None:
    """Folds all whole batches into the base table, in one step for readers, and deletes the batches of the base before."""
    base, upto = _folded(spark, root)
    later = _batches(spark, root, upto)
    if not later:
        return
    rows = index_now(spark, root).withColumn("batch", F.lit(later[-1]).cast("long"))
    mark = spark.range(1).select(F.lit(later[-1]).cast("long").alias("batch"))  # so that the number is there without any rows
    write_state(rows.unionByName(mark, allowMissingColumns=True), f"{root}/base")
    for what in ("paths", "rows"):
        fs, at = file_system(spark, f"{root}/{what}")
        for f in fs.listStatus(at):
            name = f.getPath().getName()
            if name.startswith("batch=") and int(name.split("=")[1]) <= upto:
                fs.delete(f.getPath(), True)
