"""Scans over text: grep, line search, corpus hash, duplicate texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pattern(pattern: str) -> str:
    """A pattern that doesn't compile is taken literally."""
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    return "(?i)" + pattern


def grep(docs: DataFrame, pattern: str, limit: int = 50, id_col: str = "doc_id") -> DataFrame:
    """The first `limit` documents that match, by id, with how often."""
    p = _pattern(pattern)
    return docs.filter(F.rlike("text", F.lit(p))).select(id_col, F.regexp_count("text", F.lit(p)).alias("matches")).orderBy(id_col).limit(limit)


def line_search(docs: DataFrame, pattern: str, limit: int = 50, id_col: str = "doc_id") -> DataFrame:
    """Documents by how many lines match: id, score, first matching line's number and first match."""
    p = _pattern(pattern)
    lines = docs.filter(F.rlike("text", F.lit(p))).select(id_col, F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.rlike("line", F.lit(p)))
    best = lines.groupBy(id_col).agg(F.count("*").alias("score"), (F.min("pos") + 1).alias("first_line"), F.min_by(F.regexp_extract("line", p, 0), "pos").alias("first_match"))
    return best.orderBy(F.desc("score"), id_col).limit(limit)


def corpus_hash(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 4096, bucket: Column | None = None) -> DataFrame:
    """One hash of all keys and texts, whatever their layout: each bucket of keys is hashed in key order, then the buckets' hashes in theirs.

    Two levels keep what one task gathers small: a bucket's hashes, then one hash a bucket. A key's bucket is its crc32
    modulo `buckets`, or what `bucket` says.
    """
    number = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(buckets)) if bucket is None else bucket
    line = F.concat_ws("\x00", F.col(key).cast("string"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    rows = docs.select(F.col(key).alias("k"), line.alias("line"), number.alias("b"))
    each = rows.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("corpus_hash"), F.sum("n").alias("documents"))
