"""A vault of notes as one object: graph, search and maintenance by name, with hooks around them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import chunk, health, index, links, sessions
from .operators import graph as G
from .operators import retrieve as R
from .operators.models import MODELS, Model


def operation(method):
    """A method whose hooks run around it: before:<name> with its arguments, after:<name> with its result, which a hook may
    replace by what it returns; error:<name> with what it raises."""

    @wraps(method)
    def run(self, *args, **how):
        name = method.__name__
        self.emit(f"before:{name}", args)
        try:
            result = method(self, *args, **how)
        except Exception as e:
            self.emit(f"error:{name}", e)
            raise
        return self.emit(f"after:{name}", result)

    return run


class Vault:
    """Notes (path, id, title, basename, aliases, content) and optionally turns of conversations (conv_id, turn, role, text)."""

    def __init__(self, notes: DataFrame, turns: DataFrame | None = None, model: Model | None = None):
        self.notes, self.turns, self.model = notes, turns, model or MODELS.by_key("hash-64")
        self._hooks: dict[str, list[Callable]] = defaultdict(list)

    def on(self, event: str, hook: Callable) -> Callable[[], None]:
        """Registers a hook; calling what is returned takes it off again."""
        self._hooks[event].append(hook)
        return lambda: self._hooks[event].remove(hook)

    def emit(self, event: str, value):
        for hook in list(self._hooks[event]):
            got = hook(value)
            value = value if got is None else got
        return value

    @operation
    def links(self) -> DataFrame:
        return G.resolve(G.mentions(self.notes), G.note_keys(self.notes))

    @operation
    def backlinks(self, *titles: str) -> DataFrame:
        asked = self.notes.sparkSession.createDataFrame([(t,) for t in titles], "title string")
        return G.backlinks_of(G.backlinks(self.links()), asked)

    @operation
    def stats(self) -> DataFrame:
        return G.graph_stats(self.notes, self.links())

    @operation
    def graph(self) -> tuple[DataFrame, DataFrame]:
        found = self.links()
        return G.graph_nodes(self.notes, found), G.graph_links(found)

    @operation
    def health(self) -> DataFrame:
        return health.health_report(self.notes, self.links())

    @operation
    def issues(self) -> DataFrame:
        return health.link_issues(self.notes, self.links())

    @operation
    def suggestions(self) -> DataFrame:
        found = self.links().select("src_path", F.col("dst_path").alias("path"))
        return links.suggest_links(links.match_targets(links.extract_anchors(self.notes), self.notes), found)

    @operation
    def chunks(self) -> DataFrame:
        """chunk_id (a hash of path and place), path, chunk_index, content and embedding."""
        rows = chunk.chunk_notes(self.notes).select(F.xxhash64("path", "chunk_index").alias("chunk_id"), "path", "chunk_index", "content")
        return index.embed(rows, "content", self.model.make(), self.model.passage_prefix)

    @operation
    def search(self, text: str, k: int = 10) -> DataFrame:
        """path, vector_score, keyword_score and score of the k best notes for a text."""
        spark, rows = self.notes.sparkSession, self.chunks()
        query = index.embed(spark.createDataFrame([(0, text)], "query_id long, content string"), "content", self.model.make(), self.model.query_prefix)
        hits = R.vector_topk(rows, query.select("query_id", F.col("embedding").alias("vector")), max(5 * k, 50))
        named = rows.select("chunk_id", F.xxhash64("path").alias("note_id"), "path", "content")
        best = hits.join(named, "chunk_id").groupBy("query_id", "note_id").agg(F.max("similarity").alias("score"))
        found = R.hybrid_search(best, named, R.query_terms(query.select("query_id", F.col("content").alias("text"))), k)
        paths = named.select("note_id", "path").distinct()
        return found.join(paths, "note_id").orderBy(F.desc("score"), "path").limit(k).select("path", "vector_score", "keyword_score", "score")

    @operation
    def messages(self, *terms: str) -> DataFrame:
        return sessions.message_search(self.turns, list(terms))
