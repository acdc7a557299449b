"""Training rows for the classifiers: a bounded, seeded sample of each class of the labelled rows that aren't held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documented bounds of the only sampled thing here, the rows a model learns from: per class, bytes of each text, and bytes of a class.
PER_CLASS, MAX_BYTES, CLASS_BYTES = 1500, 1 << 16, 16 << 20


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """crc32 of doc_id as text leaves `rest`; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> tuple[list[str], list[int], float]:
    """Texts, labels and the share of label 1 among all labelled rows that aren't held out.

    The sample is the per_class rows of least seeded hash of doc_id and text in each class, so it doesn't depend on the
    layout; repeated label rows count once, and a document whose labels differ counts as their maximum. Null labels and
    ids are left out, as are texts above max_bytes, and what comes after CLASS_BYTES of a class's texts, so at most twice
    that many bytes reach the driver.
    """
    known = labels.select(F.col("doc_id"), F.col(label).alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, rest))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["c"] for r in known.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("c")).collect()}
    # Twice as many ids as rows wanted leaves room for ids without a text; both bounds are fixed, so this broadcast is too.
    ids = None
    for y in (0, 1):
        one = known.filter((F.col("y") > 0) == bool(y)).orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id").limit(2 * per_class)
        ids = one if ids is None else ids.union(one)
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= max_bytes).join(F.broadcast(ids), "doc_id").select((F.col("y") > 0).cast("int").alias("y"), "text", F.xxhash64("doc_id", "text").alias("h"))
    texts: list[str] = []
    ys: list[int] = []
    some = rows.filter("y = 0").orderBy("h").limit(per_class).union(rows.filter("y = 1").orderBy("h").limit(per_class))
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, 0))  # of 2 * per_class rows
    got = some.withColumn("size", size).filter(F.col("size") <= CLASS_BYTES).collect()
    for r in sorted(got, key=lambda r: r["h"]):
        texts.append(r["text"])
        ys.append(r["y"])
    total = sum(sizes.values())
    return texts, ys, (sizes.get(1, 0) / total if total else 0.5)


def prior_shift(ys: list[int], share: float) -> float:
    """What to add to a logit learnt on the balanced sample so that it stands for the labelled population."""
    import math

    pos, neg = sum(ys), len(ys) - sum(ys)
    if not pos or not neg or not 0 < share < 1:
        return 0.0
    return math.log(share / (1 - share)) - math.log(pos / neg)
