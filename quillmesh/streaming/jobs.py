"""Structured Streaming: incremental indexing of arriving notes, debounced changes, and event windows (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_path(batch: DataFrame) -> DataFrame:
    """Each path's last version in a micro-batch: what a debounce of changes leaves."""
    return batch.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("content")))).filter("_r = 1").drop("_r")


def index_stream(files: DataFrame, index_path: str, checkpoint: str, make_rows, trigger: dict | None = None):
    """Starts a query that keeps the index at index_path current with a stream of files (path, content, mtime).

    Each micro-batch writes the rows of its paths under batch=<id>, overwriting that folder, so a batch that is run again
    after a failure leaves the same index. current_index() reads the newest batch of each path.
    """

    def write(batch: DataFrame, n: int) -> None:
        rows = make_rows(latest_per_path(batch))
        rows.write.mode("overwrite").parquet(f"{index_path}/batch={n}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_index(spark, index_path: str) -> DataFrame:
    """Rows of each path's newest batch."""
    rows = spark.read.parquet(index_path)
    newest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["path", "batch"], "left_semi")


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream gets a watermark, which needs timestamps with a zone; a table stays as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of each window; with a watermark, so it works on streams and tables alike."""
    w = _marked(events, late)
    return w.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type and n of windows that begin each `step`; events without a time are in none, an empty table gives none."""
    w = _marked(events, late)
    return w.groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n and total of each user's events that follow one another within `gap`; a null user is one."""
    w = _marked(events, late)
    return w.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")
