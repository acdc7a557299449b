"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters: a row's shard is the one of highest seeded hash with its doc_id (rendezvous), and a second seeded hash
of the row spreads a shard's rows evenly over memory-sized buckets. Pass 2 gathers a bucket's records in one array,
draws a Fisher-Yates permutation from seeded hashes, and writes the shuffled bucket. A shard is its shuffled buckets one
after another, so slots are gapless, and every order of its rows is equally likely.

The `key` law holds: doc_id and the number of shards alone decide the shard, and one more shard takes rows only into
itself. Buckets are numbered from the table's bytes and rows, so none outgrows a task's memory at any input size; they
are dealt by a hash of the whole row and its number within its scan partition, so a source, a doc_id or a text that a
third of the rows share is spread over its shard's buckets like other rows. The shuffled shards are a written table:
later reads never draw anew. Nothing reaches the driver but one row of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SEED, BUCKET_BYTES, BUCKET_ROWS = 20240613, 2 << 20, 384


def rendezvous(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of highest seeded hash with the key; ties go to the larger number, null is a key like any other."""
    key = F.xxhash64(doc_id, F.lit(seed))
    return F.array_max(F.array(*[F.struct(F.xxhash64(key, F.lit(seed + 1 + k)).alias("h"), F.lit(k).alias("k")) for k in range(shards)]))["k"]


def fisher_yates(size: Column, seed: Column) -> Column:
    """A permutation of 0 .. size - 1: each i takes the place of a hash-drawn j <= i, whose number moves to the end."""
    start = F.slice(F.array(F.lit(0)), 1, 0)

    def place(done: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(seed, i), i + 1).cast("int")
        drawn = F.concat(F.slice(done, F.lit(1), j), F.array(i), F.slice(done, j + 2, F.greatest(i - j - 1, F.lit(0))), F.array(F.try_element_at(done, j + 1)))
        return F.when(j == i, F.concat(done, F.array(i))).otherwise(drawn)

    return F.aggregate(F.sequence(F.lit(0), size - 1), start, place)


def shard(docs: DataFrame, shards: int = 40, *, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The written shards: doc_id, text, shard, bucket and place (the row's number in its shuffled bucket).

    Columns other than doc_id and text are not read. A null text stays null; rows are repeated as they come; an empty
    table gives empty shards.
    """
    sums = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("bytes")).first()
    each = max(1, -(-int(sums["bytes"]) // (shards * bucket_bytes)), -(-int(sums["rows"]) // (shards * bucket_rows)))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    rows = rows.select("doc_id", "text", rendezvous(F.col("doc_id"), shards, seed).alias("shard"), F.xxhash64("doc_id", "text", F.monotonically_increasing_id(), F.lit(seed)).alias("draw"))
    rows = rows.withColumn("bucket", F.col("shard").cast("long") * each + F.pmod("draw", F.lit(each)))
    dealt = rows.repartition(F.col("bucket"))  # the scatter; grouping below needs no other exchange
    bucket = dealt.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("draw", "doc_id", "text"))).alias("records"))
    mixed = bucket.withColumn("order", fisher_yates(F.size("records"), F.xxhash64("bucket", F.lit(seed))))
    placed = mixed.select("bucket", "records", F.posexplode("order").alias("place", "take"))
    placed = placed.select(F.element_at("records", F.col("take") + 1).alias("r"), "bucket", F.col("place").cast("long").alias("place"))
    return materialize(placed.select("r.doc_id", "r.text", F.floor(F.col("bucket") / each).cast("int").alias("shard"), "bucket", "place"), "shards")


def shard_slots(docs: DataFrame, shards: int = 40, *, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, read back from the written shards."""
    written = shard(docs, shards, seed=seed)
    light = written.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "bucket",
        "place",
        rendezvous(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # A shard's bucket counts: a few bytes for each bucket, sorted and summed as they stream by.
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return light.join(before, "bucket").select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("place")).alias("slot"), "grown_shard")
