"""Occurrences of many titles in many texts, by Aho-Corasick automata.

One automaton finds every title in one pass over a text, so the work does not grow with the number of titles. Titles are
dealt in shards of SHARD_CHARS. Each shard is broadcast, and a worker builds its automaton once; the texts are read again for
every shard, as titles are few beside texts. Neither texts nor what is found in them is shuffled.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, forget, materialize

#: Code points of the titles of an automaton, and notes of a text batch that are searched before their rows are handed on.
SHARD_CHARS, NOTES_PART = 1 << 22, 500
HITS = "path string, target string, start int, end int, context string"
_KEPT: dict[object, object] = {}


def fold(text: str) -> str:
    """Lower case of the same length: a code point whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Finder:
    """An automaton over (title, owner): the path of the one note that has the title, or None if several have it."""

    def __init__(self, titles: list[tuple[str, str | None]]):
        import ahocorasick

        by_key: dict[str, list[tuple[str, str | None]]] = {}
        for title, owner in titles:
            by_key.setdefault(fold(title), []).append((title, owner))
        self.automaton = ahocorasick.Automaton()
        for key, own in by_key.items():
            self.automaton.add_word(key, (len(key), sorted(own, key=lambda x: x[0])))
        if by_key:
            self.automaton.make_automaton()
        self.some = bool(by_key)

    def hits(self, path: str | None, text: str, whole_words: bool, overlapping: bool = False) -> Iterator[tuple[str, int, int]]:
        """(title, start, end) of each title that is not the note's own; occurrences of one title from the left, without
        overlap unless asked for."""
        if not self.some:
            return
        word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        past: dict[str, int] = {}
        for last, (size, own) in self.automaton.iter(fold(text)):
            start, end = last - size + 1, last + 1
            if whole_words and (word(start - 1) or word(end)):
                continue
            for title, owner in own:
                if (owner is None or owner != path) and (overlapping or start >= past.get(title, 0)):
                    past[title] = end
                    yield title, start, end


def named(titles: DataFrame, least: int) -> DataFrame:
    """title and owner of the distinct titles of `least` code points or more; owner is null where several notes have it."""
    own = titles.filter(F.length("title") >= least).groupBy("title").agg(F.min("path").alias("a"), F.max("path").alias("b"))
    return own.select("title", F.when(F.col("a") == F.col("b"), F.col("a")).alias("owner"))


def find_titles(notes: DataFrame, titles: DataFrame, schema: str, of_hits, *, least: int, whole_words: bool, overlapping: bool = False) -> DataFrame:
    """of_hits(path, text, hits) -> rows of schema, over all notes (path, content) and the hits of titles (path, title) of one
    shard; a note that has hits of several shards is given to of_hits once for each."""
    spark, own = notes.sparkSession, named(titles, least)
    bound_batches(spark)
    size = int(own.agg(F.sum(F.length("title") + 1)).first()[0] or 0)
    shards = max(1, -(-size // SHARD_CHARS))
    columns = [c.split()[0] for c in schema.split(", ")]
    texts = notes.select("path", "content").filter("content is not null")

    own = materialize(own.withColumn("shard", F.pmod(F.xxhash64("title"), F.lit(shards)).cast("int")), "titles") if shards > 1 else own.withColumn("shard", F.lit(0))

    def found_in(shard: int) -> DataFrame:
        shared, name = spark.sparkContext.broadcast([tuple(r) for r in own.filter(F.col("shard") == shard).select("title", "owner").collect()]), uuid.uuid4().hex

        def scan(batches):
            finder = _KEPT.get(name)
            if finder is None:
                _KEPT.clear()
                finder = _KEPT[name] = Finder(shared.value)
            for b in batches:
                for k in range(0, len(b), NOTES_PART):
                    part = b.iloc[k : k + NOTES_PART]
                    rows = [r for p, t in zip(part["path"], part["content"], strict=True) for r in of_hits(p, t, finder.hits(p, t, whole_words, overlapping))]
                    yield pd.DataFrame(rows, columns=columns)

        return texts.mapInPandas(scan, schema)

    out = found_in(0)
    for shard in range(1, shards):
        out = out.union(found_in(shard))
    forget(own)
    return out


def title_hits(notes: DataFrame, titles: DataFrame, *, least: int = 2, whole_words: bool = False, overlapping: bool = False) -> DataFrame:
    """path, target, start and end of every occurrence of a title (path, title) in a note (path, content), whatever its case;
    of one title in one note from the left, without overlap unless asked for. A note's own title counts only if another note has it, too.
    Null contents and titles have none; of an empty table there are none; repeated notes are each searched."""
    return find_titles(notes, titles, "path string, target string, start int, end int", lambda p, t, hits: [(p, *h) for h in hits], least=least, whole_words=whole_words, overlapping=overlapping)


def title_counts(notes: DataFrame, titles: DataFrame, *, least: int = 2) -> DataFrame:
    """path, target and n: how often each title (path, title) occurs in each note (path, content), as title_hits finds it, counted
    where the note is read. Repeated notes have rows of their own."""
    count = lambda p, t, hits: [(p, title, n) for title, n in Counter(h[0] for h in hits).items()]
    return find_titles(notes, titles, "path string, target string, n long", count, least=least, whole_words=False)
