"""Health of a note graph: metrics, hubs, anomalies, score, status, recommendations; and link issues and their repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..session import materialize
from . import graph as G
from .fuzzy import fuzzy_candidates

#: Shares from which a state is unhealthy.
THRESHOLDS = {"no_backlinks": 0.6, "no_outlinks": 0.5, "orphans": 0.3, "hub": 0.2, "hub_high": 0.5, "dangling": 0.2}


def graph_metrics(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: notes, mean, most and most-linked title of backlinks, shares without backlinks, without links, orphans, density, mentions, connections, dangling mentions."""
    e = G.edges(resolved)
    into = e.groupBy(F.col("dst_path").alias("path")).agg(F.count("*").alias("b"))
    out = e.groupBy(F.col("src_path").alias("path")).agg(F.count("*").alias("o"))
    per = notes.select("path", "title").join(into, "path", "left").join(out, "path", "left").select("path", "title", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("o", F.lit(0)).alias("o"))
    n = F.count("*")
    one = per.agg(
        n.alias("note_count"),
        F.avg("b").alias("avg_backlinks"),
        F.max("b").alias("max_backlinks"),
        F.max_by("title", F.struct(F.col("b"), F.col("path"))).alias("max_title"),
        (F.count_if(F.col("b") == 0) / n).alias("no_backlinks"),
        (F.count_if(F.col("o") == 0) / n).alias("no_outlinks"),
        (F.count_if((F.col("b") == 0) & (F.col("o") == 0)) / n).alias("orphans"),
        (F.sum("o") / F.greatest(n * (n - 1), F.lit(1))).alias("density"),
    )
    said = resolved.agg(F.count("*").alias("mentions"), F.count_if(F.col("dst_path").isNull()).alias("dangling_mentions"))
    return one.crossJoin(said)  # two single rows


def hubs(resolved: DataFrame, share: float = THRESHOLDS["hub"], least: int = 0) -> DataFrame:
    """Targets whose distinct backlinks are at least `share` of all: dst_title, backlinks, share, severity."""
    counts = G.backlinks(resolved).groupBy("dst_title", "dst_path").agg(F.count("*").alias("backlinks"))
    total = counts.agg(F.sum("backlinks").alias("total"))
    shares = counts.join(F.broadcast(total)).withColumn("share", F.col("backlinks") / F.col("total"))
    return shares.filter((F.col("share") >= share) & (F.col("backlinks") >= least)).select("dst_title", "backlinks", "share", F.when(F.col("share") >= THRESHOLDS["hub_high"], "high").otherwise("medium").alias("severity"))


def health_score(no_backlinks: Column, no_outlinks: Column, orphans: Column, hub: Column, dangling: Column) -> Column:
    """100 less capped penalties, rounded."""
    lost = F.least(40 * no_backlinks + 20 * no_outlinks, F.lit(30.0)) + F.least(80 * orphans, F.lit(25.0)) + F.least(50 * hub, F.lit(25.0)) + F.least(60 * dangling, F.lit(20.0))
    return F.greatest(F.lit(0), F.round(100 - lost).cast("int"))


def health_report(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: the metrics, the largest hub's share, score, status and recommendations."""
    m = graph_metrics(notes, resolved)
    top = hubs(resolved, 0.0).agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("hub_share"))
    dang = F.when(F.col("mentions") > 0, F.col("dangling_mentions") / F.greatest("mentions", F.lit(1))).otherwise(0.0)
    score = health_score(F.col("no_backlinks"), F.col("no_outlinks"), F.col("orphans"), F.when(F.col("hub_share") >= THRESHOLDS["hub"], F.col("hub_share")).otherwise(0.0), dang)
    r = m.crossJoin(top).withColumn("dangling_share", dang).withColumn("score", score)
    r = r.withColumn("status", F.when(F.col("score") < 50, "critical").when(F.col("score") < 75, "warning").otherwise("healthy"))
    rules = (
        (F.col("no_backlinks") > THRESHOLDS["no_backlinks"], "link to more notes: most have no backlinks"),
        (F.col("no_outlinks") > THRESHOLDS["no_outlinks"], "add links: most notes link nowhere"),
        (F.col("orphans") > THRESHOLDS["orphans"], "connect orphan notes"),
        (F.col("hub_share") >= THRESHOLDS["hub"], "split hub notes"),
        (F.col("dangling_share") > THRESHOLDS["dangling"], "repair dangling links"),
    )
    return r.withColumn("recommendations", F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda x: x.isNotNull()))


def duplicate_links(resolved: DataFrame) -> DataFrame:
    """Targets that a note mentions more than once: src_path, target, occurrences, severity."""
    return resolved.groupBy("src_path", "target").agg(F.count("*").alias("occurrences")).filter("occurrences > 1").withColumn("severity", F.when(F.col("occurrences") > 3, "medium").otherwise("low"))


def link_issues(notes: DataFrame, resolved: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Dangling, duplicate and hub issues in one frame: kind, severity, src_path, target, suggested, action, confidence.

    The links are found once and written: all three kinds of issues read them, some twice.
    """
    resolved = materialize(resolved, "issue-links")
    titles = notes.select(F.col("title").alias("text")).union(notes.select("basename")).distinct()
    open_ = G.dangling(resolved)
    best = fuzzy_candidates(open_.select(F.col("target").alias("text")), titles, threshold, 1)
    dang = open_.join(best.select(F.col("text").alias("target"), "other", "similarity"), "target", "left").select(
        F.lit("dangling").alias("kind"),
        F.when(F.col("other").isNotNull(), "medium").otherwise("high").alias("severity"),
        "src_path",
        "target",
        F.col("other").alias("suggested"),
        F.when(F.col("other").isNotNull(), "replace").otherwise("create").alias("action"),
        F.coalesce("similarity", F.lit(0.0)).alias("confidence"),
    )
    nothing = F.lit(None).cast("string")
    dup = duplicate_links(resolved).select(F.lit("duplicate"), "severity", "src_path", "target", nothing, F.lit("review"), F.lit(0.0))
    hub = hubs(resolved).select(F.lit("hub"), "severity", nothing, "dst_title", nothing, F.lit("split"), F.lit(0.5))
    return dang.union(dup).union(hub)


def apply_repairs(notes: DataFrame, repairs: DataFrame, least: float = 0.8) -> DataFrame:
    """notes with `repaired` content and how many repairs were applied; only confident replacements (path, target, suggested, confidence).

    Targets are replaced literally, inside link brackets, in the order of the targets.
    """
    safe = repairs.filter((F.col("confidence") >= least) & F.col("suggested").isNotNull() & (F.col("action") == "replace"))
    per = safe.groupBy(F.col("src_path").alias("path")).agg(F.array_sort(F.collect_set(F.struct("target", "suggested"))).alias("r"))
    joined = notes.join(per, "path", "left")

    def put(text: Column, fix: Column) -> Column:
        """The target between [[ and what ends it, taken literally on both sides."""
        found = F.concat(F.lit(r"\[\[\s*\Q"), fix["target"], F.lit(r"\E\s*(?=[\]|#])"))
        return F.regexp_replace(text, found, F.concat(F.lit("[["), F.regexp_replace(fix["suggested"], r"([\\$])", r"\\$1")))

    done = F.aggregate(F.coalesce("r", F.array().cast("array<struct<target:string,suggested:string>>")), F.col("content"), put)
    return joined.withColumn("repaired", done).withColumn("applied", F.coalesce(F.size("r"), F.lit(0))).drop("r")


def link_lines(notes: DataFrame, targets: DataFrame) -> DataFrame:
    """path, target and 1-based line of lines that link to a target, whatever its case."""
    lines = notes.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line")).select("path", "pos", F.explode(F.array_distinct(F.transform(T.repair_targets("line"), lambda t: F.lower(t)))).alias("low"))
    return lines.join(targets.select("target", F.lower("target").alias("low")).distinct(), "low").select("path", "target", (F.col("pos") + 1).alias("line_number"))
