"""The embedding cache, chunks by SQL, and the keyword search's two ways."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import chunk, sessions
from quillmesh.operators import retrieve as R
from quillmesh.operators.embed_cache import EmbeddingCache


@pytest.fixture
def cache(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def embedder(texts: pd.Series) -> pd.Series:
        with open(seen, "a") as f:
            f.write(f"{len(texts)}\n" + "".join(f"={t}\n" for t in texts))
        return pd.Series([[float(len(t)), 1.0] for t in texts])

    def calls() -> tuple[list[str], int]:
        try:
            lines = open(seen).read().split("\n")
        except FileNotFoundError:
            return [], 0
        return sorted(x[1:] for x in lines if x.startswith("=")), max(int(x) for x in lines if x and not x.startswith("="))

    made = EmbeddingCache(spark, "cache_test", "m1", embedder, most=6, buckets=3, batch=2)
    made.clear()
    yield made, calls, embedder
    made.clear()


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")


def stats(c):
    r = c.stats().first()
    return r.entries, r.hits, r.misses, round(r.hit_rate, 6)


def test_a_second_run_embeds_nothing(spark, cache):
    c, calls, _ = cache
    texts = ["a", "bb", "a", None, "", " \n", "ccc"]
    want = [None if not (t or "").strip() else [float(len(t)), 1.0] for t in texts]
    for _ in range(2):
        got = c.embed(frame(spark, texts)).orderBy("id").collect()
        assert [r.embedding for r in got] == want and [r.content for r in got] == texts
    assert calls()[0] == ["a", "bb", "ccc"] and calls()[1] <= 2
    assert stats(c) == (3, 3, 0, 1.0) and len(c.versions()) == 2
    c.embed(frame(spark, ["a", "new"])).collect()
    assert stats(c) == (4, 1, 1, 0.5)
    assert c.embed(frame(spark, ["a"]).limit(0)).count() == 0 and stats(c)[0] == 4


def test_models_don_t_share_and_the_oldest_use_goes_first(spark, cache):
    c, calls, embedder = cache
    c.embed(frame(spark, ["a", "b", "c", "d"])).collect()
    other = EmbeddingCache(spark, "cache_test", "m2", embedder, most=6, buckets=3)
    other.embed(frame(spark, ["a"])).collect()
    assert calls()[0] == ["a", "a", "b", "c", "d"] and stats(c)[0] == 5
    c.embed(frame(spark, ["a", "x", "y"])).collect()  # 7 entries: one of the first use that was not asked again goes
    assert stats(c)[:3] == (6, 1, 2)
    c.embed(frame(spark, ["a", "x", "y"])).collect()
    assert stats(c) == (6, 3, 0, 1.0)
    c.embed(frame(spark, [f"t{k}" for k in range(20)])).collect()  # more than there is room for
    assert stats(c) == (6, 0, 20, 0.0) and c.entries().agg(F.min("used"), F.max("used")).first()[0] == c.versions()[-1]


def test_the_cache_is_not_shuffled(spark, cache):
    c, _, _ = cache
    c.embed(frame(spark, ["a", "b"])).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = frame(spark, ["a", "z"]).select(c.key(F.col("content")).alias("hash"))
        plan = asked.join(c.entries(), "hash", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    right = plan[plan.rindex("Scan") - 400 :]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in right


def test_chunks_by_sql_equal_the_frame(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    notes = d.select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("# Head\n"), F.coalesce("text", F.lit(""))).alias("content"))
    notes.createOrReplaceTempView("notes_for_chunks")
    chunk.register(spark)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(spark.sql("SELECT * FROM chunk_notes(TABLE(notes_for_chunks))")) == key(chunk.chunk_notes(notes))
    small = spark.sql("SELECT * FROM chunk_notes(TABLE(notes_for_chunks) PARTITION BY path, size => 300, overlap => 30)")
    assert key(small) == key(chunk.chunk_notes(notes, 300, 30)) and small.count() > notes.count()
    for wrong, what in (("TABLE(SELECT 1 AS x)", "missing: content, path"), ("TABLE(notes_for_chunks), size => 0", "size must be positive")):
        with pytest.raises(Exception, match=what):
            spark.sql(f"SELECT * FROM chunk_notes({wrong})").collect()


def test_many_asked_words_are_joined(spark, monkeypatch):
    """Words that travel and words that are joined give the same."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("note_id"), F.col("text").alias("content"))
    b = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    key = lambda: sorted((r.query_id, r.note_id, r["rank"], r.score) for r in R.bm25_best(d, R.query_terms(b), 5).collect())
    few = key()
    monkeypatch.setattr(R, "ASKED_MOST", 3)
    assert key() == few and few


def test_searches_for_nothing(spark):
    turns = spark.createDataFrame([(1, 1, "user", "hello"), (2, 1, "user", None)], "conv_id long, turn long, role string, text string")
    assert sessions.message_search(turns, []).collect() == []
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, None), (2, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r.query_id, r.chunk_id) for r in R.vector_topk(chunks, queries, 3).collect()] == [(2, 1)]
    assert R.vector_topk(chunks, queries.limit(1), 3).collect() == []
