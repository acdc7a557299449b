"""Evaluation: ranking metrics, link metrics, answerability, percentiles, dataset statistics, regression of snapshots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .percentiles import exact_percentiles


def search_item_metrics(items: DataFrame, k: int = 10) -> DataFrame:
    """items (retrieved, expected) with hit_at_1, hit_at_k, reciprocal_rank, recall_at_k and ndcg_at_k by normalized path.

    Normal forms, and the places of hits among all that was retrieved, are columns of their own, so they are made once.
    """
    i = items.withColumns({"_got": F.transform("retrieved", T.normalize_path), "_want": F.array_distinct(F.transform("expected", T.normalize_path))})
    places = F.filter(F.transform("_got", lambda p, i: F.when(F.array_contains("_want", p), i + 1)), lambda i: i.isNotNull())
    i = i.withColumns({"_at": places, "_n": F.size("_want"), "_met": F.size(F.array_intersect("_want", F.slice("_got", 1, k)))})
    first = F.try_element_at("_at", F.lit(1))
    gain = F.aggregate(F.filter("_at", lambda i: i <= k), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    best = F.element_at(F.array(*[F.lit(idcg(n)) for n in range(1, k + 1)]), F.greatest(F.least("_n", F.lit(k)), F.lit(1)))
    some = F.col("_n") > 0
    out = i.select(
        *items.columns,
        F.when(some & (first == 1), 1).otherwise(0).alias("hit_at_1"),
        F.when(some & (first <= k), 1).otherwise(0).alias("hit_at_k"),
        F.when(some & first.isNotNull(), 1 / first).otherwise(0.0).alias("reciprocal_rank"),
        F.when(some, F.col("_met") / F.col("_n")).otherwise(0.0).alias("recall_at_k"),
        F.when(some, gain / best).otherwise(0.0).alias("ndcg_at_k"),
    )
    return out


def search_summary(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over answerable items with expectations; latency p50 and p95 over all, exactly (see exact_percentiles). `by` adds
    slices by rollup: each level's rows have null in the columns after it. An empty table gives one row without `by`."""
    use = F.col("answerable") & (F.size("expected") > 0)
    mean = lambda c: F.avg(F.when(use, F.col(c)))
    by, levels = by or [], len(by or []) + 1
    # A row for each level of the rollup it counts for; what a level leaves out is null.
    level = F.explode(F.array(*[F.struct(F.lit(d).alias("_level"), *[(F.col(c) if i < d else F.lit(None).cast(items.schema[c].dataType)).alias(c) for i, c in enumerate(by)]) for d in range(levels)]))
    measured = ["answerable", "expected", "hit_at_1", "hit_at_k", "reciprocal_rank", "recall_at_k", "ndcg_at_k", "latency_ms"]
    rows = items.select(*measured, level.alias("_s")).select(*measured, "_s.*")
    means = rows.groupBy("_level", *by).agg(
        F.count("*").alias("items"),
        mean("hit_at_1").alias("hit_at_1"),
        mean("hit_at_k").alias("hit_at_k"),
        mean("reciprocal_rank").alias("mrr"),
        mean("recall_at_k").alias("recall_at_k"),
        mean("ndcg_at_k").alias("ndcg_at_k"),
    )
    times = exact_percentiles(rows, "latency_ms", {"p50": 0.5, "p95": 0.95}, ["_level", *by]).select(F.col("_level").alias("_l"), *[F.col(c).alias(f"_{c}") for c in by], "p50", "p95")
    same = F.col("_level") == F.col("_l")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = means.join(times, same, "left").drop("_l", *[f"_{c}" for c in by])
    if not by:
        out = items.sparkSession.range(1).select(F.lit(0).alias("_level")).join(out, "_level", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    return out.drop("_level")


def link_item_metrics(items: DataFrame, k: int = 5) -> DataFrame:
    """items (suggested, expected, existing) with precision (by what was returned), recall, f1, hit and novelty at k."""
    got = F.slice(F.transform("suggested", T.normalize_path), 1, k)
    want, known = F.transform("expected", T.normalize_path), F.transform("existing", T.normalize_path)
    hits = F.size(F.filter(got, lambda p: F.array_contains(want, p)))
    p = F.when(F.size(got) > 0, hits / F.size(got)).otherwise(0.0)
    r = F.when(F.size(want) > 0, F.size(F.array_intersect(F.array_distinct(want), got)) / F.size(F.array_distinct(want))).otherwise(0.0)
    new = F.size(F.filter(got, lambda x: ~F.array_contains(known, x)))
    return items.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), (hits > 0).cast("int").alias("hit"), F.when(F.size(got) > 0, new / F.size(got)).otherwise(0.0).alias("novelty"))


def confusion(items: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row; unanswerable is the positive class: tp, fp, fn, tn, precision, recall, f1, false answer rate, accuracy."""
    c = items.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).withColumn("false_answer_rate", ratio(fn, tp + fn)).withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))


def unanswerable(score: Column, threshold: float) -> Column:
    """Whether a query counts as unanswerable: no best score, or one under the threshold."""
    return score.isNull() | (score < threshold)


def dataset_stats(items: DataFrame) -> DataFrame:
    """facet, value, items: counts by language, difficulty and tag."""
    one = lambda name: items.filter(F.col(name).isNotNull()).groupBy(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value")).agg(F.count("*").alias("items"))
    tags = items.select(F.explode("tags").alias("value")).groupBy(F.lit("tag").alias("facet"), "value").agg(F.count("*").alias("items"))
    return one("language").union(one("difficulty")).union(tags)


def worst_cases(items: DataFrame, n: int = 10) -> DataFrame:
    return items.orderBy(F.coalesce("reciprocal_rank", "precision", F.lit(0.0)), "id").limit(n)


#: What counts as a regression, by phase; and limits of latency and cold start.
QUALITY_DROP = {"mvp": 0.02, "beta": 0.015, "ga": 0.01}
FEW_ITEMS, FEW_DROP = 200, 0.03
P95_SHARE, P95_MS, COLD_SHARE, COLD_MS = 0.15, 200.0, 0.20, 120_000.0


def unpivot_metrics(report: DataFrame, categories: dict[str, str]) -> DataFrame:
    """A one-row report as (metric, category, value) rows."""
    pairs = ", ".join(f"'{m}', '{c}', cast(`{m}` as double)" for m, c in categories.items())
    return report.selectExpr(f"stack({len(categories)}, {pairs}) as (metric, category, value)")


def compare_snapshots(baseline: DataFrame, current: DataFrame, phase: str = "mvp", items: int = 1000) -> DataFrame:
    """metric, category, baseline, current, change and regression of every baseline metric; a missing one is none."""
    drop = max(QUALITY_DROP[phase], FEW_DROP if items < FEW_ITEMS else 0.0)
    j = baseline.select("metric", "category", F.col("value").alias("baseline")).join(current.select("metric", F.col("value").alias("current")), "metric", "left")
    change = F.col("current") - F.col("baseline")
    share = F.when(F.col("baseline") > 0, change / F.col("baseline")).otherwise(0.0)
    bad = (
        F.when(F.col("current").isNull(), F.lit(False))
        .when(F.col("category") == "latency", (share > P95_SHARE) | (change > P95_MS))
        .when(F.col("category") == "cold_start", (share > COLD_SHARE) | (change > COLD_MS))
        .when(F.col("category") == "inverted", change > drop)
        .otherwise(change < -drop)
    )
    return j.select("metric", "category", "baseline", "current", change.alias("change"), bad.alias("regression"))


def preconditions(baseline: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("dataset_hash", "notes_hash", "model")) -> DataFrame:
    """One row per key of two one-row snapshots: whether they agree; comparison is only meaningful where all do."""
    stacked = lambda df, name: df.selectExpr(f"stack({len(keys)}, {', '.join(f'{k!r}, cast(`{k}` as string)' for k in keys)}) as (key, {name})")
    return stacked(baseline, "base").join(stacked(current, "cur"), "key").select("key", "base", "cur", F.col("base").eqNullSafe(F.col("cur")).alias("same"))


def idcg(n: int) -> float:
    return sum(1 / math.log2(i + 2) for i in range(n))


def filter_items(items: DataFrame, language: str | None = None, difficulty: str | None = None, tag: str | None = None) -> DataFrame:
    """Items of a language, a difficulty, a tag; None asks for nothing."""
    for name, value in (("language", language), ("difficulty", difficulty)):
        if value is not None:
            items = items.filter(F.col(name) == value)
    return items if tag is None else items.filter(F.array_contains("tags", tag))


def dataset_averages(items: DataFrame) -> DataFrame:
    """One row: items, answerable, unanswerable, mean numbers of expected notes and spans."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    mean = lambda c: F.coalesce(F.avg(size(c)), F.lit(0.0))
    return items.agg(F.count("*").alias("items"), F.count_if(F.col("answerable")).alias("answerable"), F.count_if(~F.col("answerable")).alias("unanswerable"), mean("expected_notes").alias("avg_notes"), mean("expected_spans").alias("avg_spans"))


def link_summary(items: DataFrame) -> DataFrame:
    """Means of link_item_metrics over all items; 0 of none."""
    return items.agg(F.count("*").alias("items"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1", "hit", "novelty")])


def snapshot_compatibility(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row per key of two one-row snapshots that differs: key, level (error for the model, else warning), base, cur."""
    keys = ("model", "dataset_hash", "notes_hash", "schema_version")
    return preconditions(baseline, current, keys).filter("not same").select("key", F.when(F.col("key") == "model", "error").otherwise("warning").alias("level"), "base", "cur")
