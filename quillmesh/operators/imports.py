"""Importing a vault: id mapping, alias rewriting, title linking, images; and generated evaluation datasets."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..session import bound_batches
from .links import LINK, apply_wikilinks
from .titles import HITS, find_titles

PROTECTED = re.compile(r"\[\[.*?\]\]|\[[^\]]*\]\([^)]*\)|```.*?```|`[^`\n]*`", re.S)


def title_mapping(notes: DataFrame) -> DataFrame:
    """Pass 1: key (title or file name, in normal form) -> new id; of notes that share a key the first by path has it."""
    keys = notes.select("path", "id", F.explode(F.array("title", "basename")).alias("k")).select("path", "id", T.normalize_title("k").alias("key"))
    return keys.groupBy("key").agg(F.min(F.struct("path", "id")).alias("m")).select("key", "m.id")


def rewrite_links(notes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pass 2: notes with links to mapped targets as [[id|shown]], what was shown kept: the alias, else the target as written.

    Each note gets the mapping of its own targets by joins, so neither side is broadcast beyond Spark's size check.
    """
    said = notes.select("path", F.explode(T.wikilink_targets("content")).alias("target")).withColumn("key", T.normalize_title("target"))
    own = said.join(mapping, "key").groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("target", "id"))).alias("ids"))

    @F.pandas_udf(StringType())
    def rewrite(texts: pd.Series, ids: pd.Series) -> pd.Series:
        def one(text, known):
            known = dict(known or {})
            put = lambda m: f"[[{known[m[1].strip()]}{'#' + m[2] if m[2] else ''}|{m[3] or m[1].strip()}]]" if m[1].strip() in known else m[0]
            return LINK.sub(put, text or "")

        return pd.Series([one(t, i) for t, i in zip(texts, ids, strict=True)])

    joined = notes.join(own, "path", "left")
    return joined.withColumn("content", F.when(F.col("ids").isNull(), F.col("content")).otherwise(rewrite("content", "ids"))).drop("ids")


def title_occurrences(notes: DataFrame, titles: DataFrame, least: int = 3, around: int = 50) -> DataFrame:
    """path, target, start, end and context of whole-word occurrences of titles outside links and code, whatever their case.

    Of occurrences that overlap in a note the longest title has it, then the first by title, then by place. A note's own title
    is left out unless another note has it, too. Found by automata over all titles (see titles.find_titles). Null contents
    and titles have none; an empty table gives none.
    """

    def of_hits(path, text, hits):
        found, taken = list(hits), None
        for t, a, b in found:
            if taken is None:
                taken = [m.span() for m in PROTECTED.finditer(text)]
            if not any(a < y and b > x for x, y in taken):
                yield path, t, a, b, text[max(0, a - around) : b + around].replace("\n", " ")

    hits = find_titles(notes, titles, HITS, of_hits, least=least, whole_words=True)

    def longest_first(own: pd.DataFrame) -> pd.DataFrame:
        own = own.assign(_n=own["start"] - own["end"]).sort_values(["_n", "target", "start"])
        kept, ends, starts = [], [], []
        for i, a, b in zip(own.index, own["start"], own["end"], strict=True):
            at = bisect_left(starts, b)  # spans that begin before this one ends; they don't overlap one another
            if not at or ends[at - 1] <= a:
                starts.insert(at, a)
                ends.insert(at, b)
                kept.append(i)
        return own.loc[kept].drop(columns="_n")

    return hits.groupBy("path").applyInPandas(longest_first, HITS)


def judge(candidates: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], threshold: float = 0.5) -> DataFrame:
    """candidates with `approved`, by a scorer of batches; equal targets in equal context are judged once, a missing score rejects."""
    once = candidates.select("target", "context").distinct()

    def run(batches):
        for b in batches:
            yield b.assign(score=scorer(b).astype("float64"))

    bound_batches(once.sparkSession)
    scored = once.mapInPandas(run, "target string, context string, score double")
    return candidates.join(scored, ["target", "context"], "left").withColumn("approved", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def apply_links(notes: DataFrame, approved: DataFrame) -> DataFrame:
    """notes with approved spans (path, target, start, end) as links, from the end of the text to its start."""
    per = approved.groupBy("path").agg(F.reverse(F.array_sort(F.collect_list(F.struct("start", "end", "target")))).alias("s"))

    def put(text, s):
        shown = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        link = F.when(shown == s["target"], F.concat(F.lit("[["), shown, F.lit("]]"))).otherwise(F.concat(F.lit("[["), s["target"], F.lit("|"), shown, F.lit("]]")))
        return F.concat(F.substring(text, F.lit(1), s["start"]), link, F.substring(text, s["end"] + 1, F.lit(1 << 30)))

    joined = notes.join(per, "path", "left")
    return joined.withColumn("content", F.aggregate(F.coalesce("s", F.array().cast("array<struct<start:int,end:int,target:string>>")), F.col("content"), put)).drop("s")


def link_concepts(notes: DataFrame, concepts: DataFrame, most: int = 30) -> DataFrame:
    """notes with the first mention of each of their concepts (path, concept) as a link."""
    per = concepts.groupBy("path").agg(F.array_sort(F.collect_set("concept")).alias("_c"))

    @F.pandas_udf(StringType())
    def link(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([apply_wikilinks(t or "", list(c), most) if c is not None else t for t, c in zip(texts, terms, strict=True)])

    return notes.join(per, "path", "left").withColumn("content", link("content", "_c")).drop("_c")


def image_references(notes: DataFrame) -> DataFrame:
    """path and image of every local image a note shows."""
    return notes.select("path", F.explode(T.image_links("content")).alias("image"))


def rewrite_images(notes: DataFrame, folder: str) -> DataFrame:
    """notes with local images under `folder`, by file name."""
    c = F.regexp_replace("content", r"(!\[[^\]]*\]\()(?!https?:)(?:[^)/]*/)*([^)/]+\))", rf"$1{folder}/$2")
    return notes.withColumn("content", F.regexp_replace(c, r"(!\[\[)(?:[^\]|/]*/)*([^\]|/]+(?:\|[^\]]*)?\]\])", rf"$1{folder}/$2"))


#: Query templates by language: the question form stands first, the bare one second.
TEMPLATES = {"en": ["What is {}?", "{}"], "ko": ["{}에 대해 알려줘", "{}"], "ja": ["{}について教えて", "{}"], "zh": ["{}是什么？", "{}"]}


def generate_queries(notes: DataFrame, per_note: int = 3, seed: int = 42) -> DataFrame:
    """id, query, expected note, language and topic: a note's title and headings outside code, those of least seeded hash.

    The choice depends on the seed, the path and the topic alone, so it is the same in any order and layout.
    """

    def run(batches):
        for b in batches:
            rows = []
            for path, title, text, lang in zip(b["path"], b["title"], b["content"], b["language"], strict=True):
                heads = [m[2].strip() for m in re.finditer(r"^(#{1,3})\s+(.+)$", re.sub(r"```.*?```", "", text or "", flags=re.S), re.M)]
                topics = list(dict.fromkeys([title, *heads]))
                key = lambda t, path=path: hashlib.sha256(f"{seed}\0{path}\0{t}".encode()).digest()
                for t in [topics[0], *sorted(topics[1:], key=key)[: per_note - 1]]:
                    template = TEMPLATES[lang][1 if re.search(r"[.?!。？！]$", t) else 0]
                    rows.append(("q-" + hashlib.sha1(f"{path}\0{t}".encode()).hexdigest()[:12], template.format(t), path, lang, t))
            yield pd.DataFrame(rows, columns=["id", "query", "expected", "language", "topic"])

    n = notes.select("path", "title", "content", T.detect_language("content").alias("language"))
    bound_batches(notes.sparkSession)
    return n.mapInPandas(run, "id string, query string, expected string, language string, topic string")


def mask_sessions(turns: DataFrame, key: str) -> DataFrame:
    """turns with their text encrypted (AES-GCM, base64); unmask_sessions reads it back."""
    return turns.withColumn("text", F.base64(F.aes_encrypt("text", F.lit(key))))


def unmask_sessions(turns: DataFrame, key: str) -> DataFrame:
    return turns.withColumn("text", F.aes_decrypt(F.unbase64("text"), F.lit(key)).cast("string"))


def headings(notes: DataFrame) -> DataFrame:
    """path, level, heading, start and end (code points) of H1 to H3 outside fenced code."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"], strict=True):
                code = [m.span() for m in re.finditer(r"```.*?(?:```|\Z)", text or "", re.S)]
                for m in re.finditer(r"^(#{1,3})[ \t]+(.+)$", text or "", re.M):
                    if not any(a <= m.start() < z for a, z in code):
                        rows.append((path, len(m[1]), m[2].strip(), m.start(), m.end()))
            yield pd.DataFrame(rows, columns=["path", "level", "heading", "start", "end"])

    bound_batches(notes.sparkSession)
    return notes.select("path", "content").mapInPandas(run, "path string, level int, heading string, start int, end int")


def language_pairs(notes: DataFrame, per_topic: int = 3, seed: int = 42) -> DataFrame:
    """Pairs for a multilingual evaluation from notes (path, topic, language): a query's note and the note that answers it,
    of one topic, kind same or cross by their languages; of each topic and kind those of least seeded hash."""
    a = notes.select("topic", F.col("path").alias("source"), F.col("language").alias("source_language"))
    b = notes.select("topic", F.col("path").alias("expected"), F.col("language").alias("expected_language"))
    kind = F.when(F.col("source_language") == F.col("expected_language"), "same").otherwise("cross")
    pairs = a.join(b, "topic").filter((F.col("source") != F.col("expected")) | (F.col("source_language") == F.col("expected_language"))).withColumn("kind", kind)
    order = Window.partitionBy("topic", "kind").orderBy(F.xxhash64(F.lit(seed), "source", "expected"), "source", "expected")
    return pairs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_topic).drop("_r")
