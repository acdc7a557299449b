"""A cache of embeddings in bucketed tables: what has been embedded once, by one model, is not embedded again.

Entries are known by a hash of model and text. The table is bucketed by that hash, so finding hits and misses shuffles the
asked texts only, never the cache. Each use writes the next version of the table and then drops the one before the last, so a
version is whole or not there. Of more than `most` entries those of the oldest use go, of one use those of highest hash.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .percentiles import exact_percentiles


def batched(embedder: Callable[[pd.Series], pd.Series], size: int) -> Callable[[pd.Series], pd.Series]:
    """An embedder that is given `size` texts at most at once."""

    def run(texts: pd.Series) -> pd.Series:
        parts = [pd.Series(list(embedder(texts.iloc[k : k + size]))) for k in range(0, len(texts), size)]
        return pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype=object)

    return run


class EmbeddingCache:
    """Embeddings under a table name; embed() adds to it, stats() tells what the last use found."""

    def __init__(self, spark: SparkSession, name: str, model: str, embedder: Callable[[pd.Series], pd.Series], *, most: int = 100_000_000, buckets: int = 64, batch: int = 32):
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a table name: {name!r}")
        self.spark, self.name, self.model, self.embedder = spark, name, model, embedder
        self.most, self.buckets, self.batch = most, buckets, batch
        self.hits = self.misses = 0

    def versions(self) -> list[int]:
        """Numbers of the versions there are, in order."""
        names = self.spark.sql(f"SHOW TABLES LIKE '{self.name}_v*'").select("tableName").collect()
        return sorted(int(m[1]) for r in names if (m := re.fullmatch(re.escape(self.name.lower()) + r"_v(\d+)", r.tableName)))

    def entries(self) -> DataFrame:
        """hash, embedding and used (the number of the use that last asked for it) of all entries."""
        found = self.versions()
        return self.spark.table(f"{self.name}_v{found[-1]}") if found else self.spark.createDataFrame([], "hash string, embedding array<float>, used long")

    def key(self, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.model}\0"), text).cast("binary"), 256)

    def embed(self, df: DataFrame, text: str = "content", prefix: str = "") -> DataFrame:
        """df with an embedding column. Distinct texts that the cache has are read from it, the others embedded, `batch` at a
        time; a null or blank text is not given to the embedder and has a null embedding. An empty table changes nothing."""
        said = F.concat(F.lit(prefix), F.col(text))
        some = F.length(F.trim(F.regexp_replace(F.col(text), r"\s+", " "))) > 0
        asked = df.filter(some).select(said.alias("said")).distinct().withColumn("hash", self.key(F.col("said")))
        number = (self.versions() or [0])[-1] + 1
        have = self.entries().select("hash", "embedding")
        both = materialize(asked.join(have, "hash", "left"), "embed-asked")
        run = F.pandas_udf(batched(self.embedder, self.batch), "array<float>")
        made = materialize(both.filter("embedding is null").select("hash", run("said").alias("embedding")), "embed-new")
        counts = both.agg(F.count("*").alias("n"), F.count("embedding").alias("hits")).first()
        self.hits, self.misses = counts.hits, counts.n - counts.hits
        if counts.n:
            now = both.select("hash", F.lit(number).cast("long").alias("now"))
            kept = self.entries().join(now, "hash", "left").select("hash", "embedding", F.coalesce("now", "used").alias("used"))
            self._write(kept.union(made.select("hash", "embedding", F.lit(number).cast("long"))), number)
        vectors = both.filter("embedding is not null").select("hash", "embedding").union(made.select("hash", "embedding")).withColumnRenamed("hash", "_h")
        return df.withColumn("_k", F.when(some, self.key(said))).join(vectors, F.col("_k") == F.col("_h"), "left").drop("_k", "_h")

    def _write(self, rows: DataFrame, number: int) -> None:
        rows = materialize(rows, "embed-all")
        uses = sorted(((r.used, r.n) for r in rows.groupBy("used").agg(F.count("*").alias("n")).collect()), reverse=True)
        room, keep = self.most, F.lit(False)
        for use, n in uses:
            if n > room > 0:  # the first `room` of this use by hash; 13 digits are exact in a double, and told apart by the rest
                place = F.conv(F.substring("hash", 1, 13), 16, 10).cast("double")
                last = exact_percentiles(rows.filter(F.col("used") == use).select(place.alias("p")), "p", {"x": (room - 1) / (n - 1)}).first().x
                keep |= (F.col("used") == use) & (place <= last + 0.5)
            elif n <= room:
                keep |= F.col("used") == use
            room -= n
            if room <= 0:
                break
        out = rows.filter(keep) if sum(n for _, n in uses) > self.most else rows
        out.write.bucketBy(self.buckets, "hash").sortBy("hash").mode("errorifexists").saveAsTable(f"{self.name}_v{number}")
        for old in self.versions()[:-2]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{old}")

    def stats(self) -> DataFrame:
        """One row: entries, and of the last use hits, misses and hit_rate (0 without any)."""
        asked = self.hits + self.misses
        return self.entries().agg(F.count("*").alias("entries")).select("entries", F.lit(self.hits).cast("long").alias("hits"), F.lit(self.misses).cast("long").alias("misses"), F.lit(self.hits / asked if asked else 0.0).alias("hit_rate"))

    def clear(self) -> None:
        for v in self.versions():
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{v}")
        self.hits = self.misses = 0
