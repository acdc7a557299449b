"""Index maintenance: change detection, upserts, deletes, validation, and a deterministic embedder for tests and offline use."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches


def cdc(files: DataFrame, meta: DataFrame) -> DataFrame:
    """path and change (added, removed, changed, same): by content hash, or a modified time later than the stored one."""
    f = files.select("path", "content_hash", "mtime")
    m = meta.select("path", F.col("content_hash").alias("old_hash"), F.col("mtime").alias("old_mtime"))
    both = f.join(m, "path", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("content_hash").isNull(), "removed").when((F.col("content_hash") != F.col("old_hash")) | (F.col("old_mtime") < F.col("mtime")), "changed").otherwise("same")
    return both.select("path", change.alias("change"))


def upsert(index: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """index with new's rows in place of those of the same key; of several, the last version stays."""
    w = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(version))
    both = index.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")


def delete(index: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return index.join(keys.select(on).distinct(), on, "left_anti")


def apply_cdc(index: DataFrame, changes: DataFrame, rows: DataFrame) -> DataFrame:
    """The index after a change set: removed and changed paths go, rows of added and changed paths come."""
    gone = changes.filter(F.col("change").isin("removed", "changed"))
    fresh = rows.join(changes.filter(F.col("change").isin("added", "changed")).select("path"), "path", "left_semi")
    return delete(index, gone, "path").unionByName(fresh)


def validate(index: DataFrame, meta: DataFrame, dimensions: int) -> DataFrame:
    """path and problem: indexed but unknown, known but not indexed, another number of chunks, or wrong vector sizes."""
    have = index.groupBy("path").agg(F.count("*").cast("long").alias("chunks"), F.count_if(F.size("embedding") != dimensions).alias("bad"))
    both = have.join(meta.select("path", F.col("chunk_count").cast("long").alias("expected")), "path", "full_outer")
    problem = F.when(F.col("expected").isNull(), "orphaned").when(F.col("chunks").isNull(), "missing").when(F.col("chunks") != F.col("expected"), "count_mismatch").when(F.col("bad") > 0, "dimension_mismatch")
    return both.select("path", problem.alias("problem")).filter("problem is not null")


def hashing_embedder(dimensions: int = 64) -> Callable[[pd.Series], pd.Series]:
    """Signed feature hashing of character trigrams, to unit length: deterministic, offline."""
    import zlib

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dimensions, np.float64)
            t = f" {(t or '').lower()} "
            for i in range(len(t) - 2):
                h = zlib.crc32(t[i : i + 3].encode())
                v[h % dimensions] += 1 if h >> 31 else -1
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return embed


def embed(df: DataFrame, text: str = "content", embedder: Callable[[pd.Series], pd.Series] | None = None, prefix: str = "") -> DataFrame:
    """df with an embedding column; each distinct text is embedded once and joined back."""
    bound_batches(df.sparkSession)
    run = embedder or hashing_embedder()
    udf = F.pandas_udf(lambda s: run(s), "array<float>")
    once = df.select(text).distinct().withColumn("embedding", udf(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))))
    return df.join(once.withColumnRenamed(text, "_t"), df[text].eqNullSafe(F.col("_t")), "left").drop("_t")


def changed_files(status: DataFrame) -> DataFrame:
    """path and change of status lines such as 'A<tab>path' in column line."""
    code, path = F.substring("line", 1, 1), F.trim(F.regexp_extract("line", r"^\S+\s+(.*)$", 1))
    return status.select(path.alias("path"), F.when(code.isin("A", "?"), "added").when(code == "D", "deleted").when(code.isin("M", "R"), "updated").alias("change")).filter("change is not null")


def conflict_halves(text: Column) -> Column:
    """struct<local, remote> of a text with one conflict."""
    p = r"(?s)<<<<<<<[^\n]*\n(.*?)=======\n(.*?)>>>>>>>"
    return F.struct(F.regexp_extract(text, p, 1).alias("local"), F.regexp_extract(text, p, 2).alias("remote"))


#: Version of the index state; one of another version is built anew.
STATE_VERSION = 2


def changed_both(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Paths that changed on both sides, each once."""
    return ours.select("path").intersect(theirs.select("path"))


def state_problem(meta: DataFrame | None, dimensions: int) -> str | None:
    """Why an index can't be kept current by changes alone and is to be built anew; None if it can.

    meta has path, content_hash, mtime, chunk_count, version and dimensions, as index_step writes it.
    """
    if meta is None:
        return "missing"
    if not {"path", "content_hash", "mtime", "version", "dimensions"} <= set(meta.columns):
        return "corrupt"
    wrong = meta.agg(F.count_if((F.col("version") != STATE_VERSION) | F.col("version").isNull()).alias("v"), F.count_if(F.col("dimensions") != dimensions).alias("d"), F.count_if(F.col("path").isNull() | F.col("content_hash").isNull()).alias("n")).first()
    return "corrupt" if wrong["n"] else "version" if wrong["v"] else "dimensions" if wrong["d"] else None


def index_step(index: DataFrame | None, meta: DataFrame | None, files: DataFrame, make_rows: Callable[[DataFrame], DataFrame], dimensions: int = 64) -> tuple[DataFrame, DataFrame]:
    """The index and its state after one look at all files (path, content_hash, mtime and what make_rows reads).

    Rows of files that are gone leave, those of changed files are made anew, new ones come, the rest stays as it is. A state
    that is missing, corrupt, of another version or of other dimensions, or an index that is gone, has all made anew.
    """
    full = index is None or state_problem(meta, dimensions) is not None
    if full:
        rows = make_rows(files)
    else:
        rows = apply_cdc(index, cdc(files, meta), make_rows(files.join(cdc(files, meta).filter(F.col("change").isin("added", "changed")).select("path"), "path", "left_semi")))
    counts = rows.groupBy("path").agg(F.count("*").cast("int").alias("chunk_count"))
    state = files.select("path", "content_hash", "mtime").join(counts, "path", "left").select("path", "content_hash", "mtime", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(STATE_VERSION).alias("version"), F.lit(dimensions).alias("dimensions"))
    return rows, state


def cache_status(entries: DataFrame, depends: DataFrame, files: DataFrame, now: float, ttl: float = 300.0) -> DataFrame:
    """key and status of cache entries (key, created): expired after ttl seconds; else stale where a file it depends on
    (key, path, mtime, content_hash) is gone, or has another time and another hash; else valid."""
    f = files.select("path", F.col("mtime").alias("_m"), F.col("content_hash").alias("_h"))
    bad = depends.join(f, "path", "left").filter(F.col("_h").isNull() | ((F.col("_m") != F.col("mtime")) & (F.col("_h") != F.col("content_hash")))).select("key").distinct().withColumn("_bad", F.lit(True))
    return entries.join(bad, "key", "left").select("key", F.when(F.lit(now) - F.col("created") > ttl, "expired").when(F.col("_bad"), "stale").otherwise("valid").alias("status"))


def keys_of(depends: DataFrame, changed: DataFrame) -> DataFrame:
    """The cache keys that depend on any of changed paths."""
    return depends.join(changed.select("path").distinct(), "path", "left_semi").select("key").distinct()
