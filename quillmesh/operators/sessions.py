"""Conversations: search, summaries, statistics, merge, export. Turns have conv_id, turn, role, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def message_search(turns: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    """Turns that hold every term, newest conversation first, with the text around the first term (30 before, 70 after).
    Without terms, or of an empty table, there are none; a null text holds no term."""
    if not terms:
        return turns.limit(0).select("conv_id", "turn", "role", F.col("text").alias("context"))
    asked = F.array(*[F.lit(t.lower()) for t in terms])
    at = F.instr(F.lower("text"), terms[0].lower())
    start = F.greatest(at - 30, F.lit(1))
    found = turns.filter(T.contains_all("text", asked)).select("conv_id", "turn", "role", F.substring("text", start, at - start + 70).alias("context"))
    return found.orderBy(F.desc("conv_id"), "turn").limit(limit)


def session_summary(turns: DataFrame) -> DataFrame:
    """conv_id, messages, first_user (100 code points), last_message (80)."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    g = turns.groupBy("conv_id").agg(F.count("*").alias("messages"), first.alias("f"), F.max_by("text", "turn").alias("l"))
    return g.select("conv_id", "messages", T.preview("f", 100).alias("first_user"), T.preview("l", 80).alias("last_message"))


def session_stats(turns: DataFrame) -> DataFrame:
    """role, messages, conversations and characters."""
    return turns.groupBy("role").agg(F.count("*").alias("messages"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("characters"))


def merge_messages(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """One row per role and first 100 characters of a conversation: local's if there is one, else base's, else remote's.

    A null role or text counts as an empty one for the key; of equal rows the first by turn stays; empty tables add none."""
    tag = lambda df, p: df.select("conv_id", "turn", "role", "text", F.lit(p).alias("priority"))
    all_ = tag(local, 0).union(tag(base, 1)).union(tag(remote, 2)).withColumn("key", F.concat_ws(":", "role", F.substring("text", 1, 100)))
    w = Window.partitionBy("conv_id", "key").orderBy("priority", "turn", "text")
    return all_.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("conv_id", "turn", "role", "text", "priority")


def export_markdown(turns: DataFrame) -> DataFrame:
    """conv_id and the conversation as Markdown, turns in order; a turn whose role or text is null is left out, and an empty
    table gives no rows."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(F.lit("## "), F.initcap(m["role"]), F.lit("\n\n"), m["text"]))
    return turns.groupBy("conv_id").agg(F.array_join(lines, "\n\n").alias("markdown"))


def newest(sessions: DataFrame, by: str = "updated_at", limit: int = 10) -> DataFrame:
    """The latest sessions (id, created_at, updated_at) by a time."""
    return sessions.orderBy(F.desc(by), "id").limit(limit)


def recent(sessions: DataFrame, now, minutes: int = 30) -> DataFrame:
    """Sessions updated in the last minutes."""
    return sessions.filter(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp")) <= minutes * 60_000_000)


def with_tag(sessions: DataFrame, tag: str) -> DataFrame:
    """id and created_at of the sessions with a tag, latest first."""
    return sessions.filter(F.array_contains("tags", tag)).select("id", "created_at").orderBy(F.desc("created_at"), "id")


def session_counts(sessions: DataFrame) -> DataFrame:
    """facet (total, month or tag), value, sessions."""
    total = sessions.groupBy().agg(F.count("*").alias("sessions")).select(F.lit("total").alias("facet"), F.lit("").alias("value"), "sessions")
    months = sessions.groupBy(F.lit("month").alias("facet"), F.col("month").alias("value")).agg(F.count("*").alias("sessions"))
    tags = sessions.select(F.explode("tags").alias("value")).groupBy(F.lit("tag").alias("facet"), "value").agg(F.count("*").alias("sessions"))
    return total.union(months).union(tags)


def add_tags(rows: DataFrame, tags: list[str]) -> DataFrame:
    """rows with tags added, each once, old ones first."""
    return rows.withColumn("tags", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, tags))))


def remove_tag(rows: DataFrame, tag: str) -> DataFrame:
    return rows.withColumn("tags", F.array_remove(F.coalesce("tags", F.array().cast("array<string>")), tag))


def merge_sessions(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Sessions (id, updated_at, tags) of three sides as one each: tags of all, first seen first; the latest updated_at."""
    side = lambda df, k: df.select("id", "updated_at", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.lit(k).alias("side"))
    all_ = side(base, 0).union(side(local, 1)).union(side(remote, 2))
    tags = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("side", "tags"))), lambda x: x["tags"])))
    return all_.groupBy("id").agg(F.max("updated_at").alias("updated_at"), tags.alias("tags"))


def append_turns(turns: DataFrame, path: str) -> None:
    turns.write.mode("append").parquet(path)
