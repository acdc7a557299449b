"""The approximate vector index: its exact way against loops, recall over all rows, and semantic targets of anchors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import ann
from quillmesh.operators import links as L
from quillmesh.operators.index import embed, hashing_embedder

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def brute(rows, queries, k):
    ids, m = np.array([i for i, _ in rows]), ann.unit([v for _, v in rows])
    out = {}
    for name, v in queries:
        score = np.round(np.maximum(m @ ann.unit([v])[0], 0), 6)
        out[name] = [(int(ids[i]), float(score[i])) for i in np.lexsort((ids, -score))[:k]]
    return out


def held(df):
    out = {}
    for x in df.collect():
        out.setdefault(x.query_id, {})[x["rank"]] = (x.id, x.similarity)
    return {q: [hits[r] for r in range(1, len(hits) + 1)] for q, hits in out.items()}


@pytest.mark.parametrize("part", [20_000, 9])
def test_exact_way_equals_loops(spark, vectors, monkeypatch, part):
    monkeypatch.setattr(ann, "PART_ROWS", part)
    monkeypatch.setattr(ann, "QUERY_ROWS", part)
    quantizer = ann.train(vectors)
    queries = vectors.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    got = held(ann.search(ann.build(vectors, quantizer), quantizer, queries, 10))
    assert got == brute([tuple(r) for r in vectors.collect()], [tuple(r) for r in queries.collect()], 10)


def test_recall_of_all_rows(spark, vectors):
    """Every row as a query: nine tenths of the exact ten are found, and what is found has its exact score."""
    quantizer = ann.train(vectors)
    index = ann.build(vectors, quantizer)
    queries = vectors.select(F.col("id").alias("query_id"), "vector")
    probes = ann.tuned_probes(index, quantizer, queries, 10, rerank=15)
    exact, found = ann.search(index, quantizer, queries, 10), ann.search(index, quantizer, queries, 10, probes=probes, rerank=15)
    assert probes < len(quantizer.centres)
    assert ann.recall(found, exact) >= 0.9
    assert found.join(exact.select("query_id", "id", F.col("similarity").alias("s")), ["query_id", "id"]).filter("s <> similarity").count() == 0


def test_clustered_rows_need_few_lists(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 24))
    m = centres[r.integers(0, 40, 2000)] + 0.1 * r.normal(size=(2000, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    quantizer = ann.train(rows, lists=40, parts=8)
    index = ann.build(rows, quantizer)
    queries = rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    assert ann.recall(ann.search(index, quantizer, queries, 5, probes=4, rerank=40), ann.search(index, quantizer, queries, 5)) >= 0.9


def test_odd_rows(spark):
    schema = "id long, vector array<double>"
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (None, [1.0, 0.0, 0.0]), (4, [-1.0, 0.0, 0.0]), (5, [2.0, 0.0, 0.0])], schema)
    quantizer = ann.train(rows)
    queries = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, None), (9, [0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    got = held(ann.search(ann.build(rows, quantizer), quantizer, queries, 3))
    assert got == {7: [(1, 1.0), (5, 1.0), (2, 0.0)], 9: [(1, 0.0), (2, 0.0), (4, 0.0)]}
    empty = spark.createDataFrame([], schema)
    none = ann.train(empty)
    assert ann.search(ann.build(empty, none), none, queries, 3).count() == 0
    with pytest.raises(Exception, match="vectors differ in size"):
        ann.build(spark.createDataFrame([(1, [1.0])], schema), quantizer).collect()


def test_semantic_targets_fill_up(spark):
    """Against plain loops: direct targets first; only anchors of fewer than k get notes near by meaning, at .8 of the cosine."""
    names = ["graph theory", "graph theories", "query planning", "query planner", "vector index", "harbour"]
    notes = spark.createDataFrame([(f"{i}.md", str(i), t, t, [], "") for i, t in enumerate(names)], "path string, id string, title string, basename string, aliases array<string>, content string")
    chunks = notes.select(F.xxhash64("path").alias("id"), "path", "title")
    vectors = embed(chunks, "title").select("id", F.col("embedding").alias("vector"))
    quantizer = ann.train(vectors)
    asked = ["Graph Theory", "query plans", "vectors", "planner", "zzz"]
    anchors = spark.createDataFrame([("9.md", t, 10 * i, 10 * i + len(t), "proper_noun") for i, t in enumerate(asked)] + [("0.md", "Graph Theory", 0, 12, "proper_noun")], L.ANCHORS)
    near = L.semantic_targets(anchors, notes, ann.build(vectors, quantizer), quantizer, chunks, k=2)
    got = {(x.path, x.text): [] for x in anchors.collect()}
    for x in L.match_targets(anchors, notes, k=2, semantic=near).orderBy("rank").collect():
        got[x.src_path, x.text].append((x.path, round(x.score, 5), x.match))
    run = hashing_embedder()
    import pandas as pd

    m = np.stack(run(pd.Series(names))).astype(np.float64)
    for src, text in got:
        t = text.lower()
        direct = {}
        for i, name in enumerate(names):
            short, long_ = sorted((len(t), len(name)))
            if f"{i}.md" != src and (t in name or name in t) and short / long_ >= 0.5:
                direct[f"{i}.md"] = (1.0, "exact") if t == name else (0.7 * short / long_, "partial")
        v = run(pd.Series([t]))[0].astype(np.float64)
        cos = {f"{i}.md": max(0, float(m[i] @ v)) for i in range(len(names))}
        found = dict(direct)
        if len(direct) < 2:
            for p in sorted(cos, key=lambda p: (-round(cos[p], 6), p))[:4]:
                if p != src and cos[p] >= 0.3 and 0.8 * cos[p] >= 0.3:
                    found.setdefault(p, (0.8 * cos[p], "semantic"))
        want = sorted(((p, s, kind) for p, (s, kind) in found.items()), key=lambda x: (-x[1], x[0]))[:2]
        assert [(p, pytest.approx(s, abs=1e-5), kind) for p, s, kind in want] == got[src, text], (src, text)
    assert any(k == "semantic" for hits in got.values() for _, _, k in hits)


def test_the_exact_way_does_not_repeat_queries_by_list(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=6).tolist()) for i in range(120)] + [(200, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    quantizer = ann.train(vectors, lists=11)
    index = ann.build(vectors, quantizer)
    queries = vectors.selectExpr("id AS query_id", "vector")
    monkeypatch.setattr(ann, "EXACT_ROWS", 50)
    monkeypatch.setattr(ann, "EXACT_QUERIES", 60)
    found = ann.search(index, quantizer, queries, 4)
    assert "list" not in found._jdf.queryExecution().analyzed().toString().split("FlatMapCoGroupsInPandas")[1].split("\n")[0]
    m = ann.unit([v for _, v in rows])
    score = np.round(np.maximum(m @ m.T, 0), 6)
    ids = np.array([i for i, _ in rows])
    want = {(int(q), int(ids[j]), n) for a, q in enumerate(ids) for n, j in enumerate(np.lexsort((ids, -score[a]))[:4], 1)}
    assert {(x.query_id, x.id, x["rank"]) for x in found.collect()} == want


def test_equal_vectors_meet_a_query_once(spark, monkeypatch):
    """Against loops: rows of equal vectors, repeated rows, an id of two vectors, a bound below which nothing counts."""
    r = np.random.default_rng(9)
    some = [r.normal(size=5).tolist() for _ in range(12)]
    rows = [(int(i), some[int(i) % 12 if i < 100 else 3]) for i in r.permutation(140)] + [(7, some[3]), (7, some[7]), (5, some[0]), (900, [0.0] * 5), (901, None), (None, some[0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = spark.createDataFrame([(i, r.normal(size=5).tolist()) for i in range(30)] + [(50, [0.0] * 5), (51, None)], "query_id long, vector array<double>")
    met, formed = ann._met, []
    monkeypatch.setattr(ann, "_met", lambda members, *a: formed.append(members.count()) or met(members, *a))
    monkeypatch.setattr(ann, "EXACT_ROWS", 7)
    for k, least in ((1, 0.0), (4, 0.0), (25, 0.0), (4, 0.5)):
        want = {}
        for q, v in queries.filter("vector is not null").collect():
            best = {}
            for i, w in rows:
                if i is not None and w is not None:
                    best[i] = max(best.get(i, 0), round(max(float(ann.unit([w])[0] @ ann.unit([v])[0]), 0), 6))
            hits = [(i, s) for i, s in sorted(best.items(), key=lambda x: (-x[1], x[0])) if s >= least][:k]
            want |= {q: hits} if hits else {}
        assert held(ann.exact(vectors, queries, k, least)) == want
    assert formed == [12 + 1 + 2 + 2] * 4  # the vectors, the one of zeros, and both of two ids that have two
    with pytest.raises(Exception, match="vectors differ in size"):
        ann.exact(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vector array<double>"), queries, 3).collect()
    assert ann.exact(vectors.limit(0), queries, 3).count() == 0 and ann.exact(vectors, queries.limit(0), 3).count() == 0
