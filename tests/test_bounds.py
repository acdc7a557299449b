"""What a task holds does not grow with the input."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quillmesh.operators import retrieve as R


def test_vector_search_holds_a_bounded_number_of_scores():
    r = np.random.default_rng(1)
    rows, unit = r.normal(size=(20_000, 16)).astype(np.float32), r.normal(size=(2048, 16))
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), 16).cast(pa.list_(pa.float32()))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 10_000)), vectors[a : a + 10_000]], names=["id", "v"]) for a in (0, 10_000)]
    tracemalloc.start()
    got = list(R._scan(iter(batches), np.arange(2048), unit, 10, "id", "v"))[0].to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20, peak  # all scores of a batch are 164 MB, and there were several copies of them
    length = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
    for q in (0, 1000, 2047):
        score = np.round(np.maximum(rows.astype(float) @ unit[q] / length, 0), 6)
        want = np.lexsort((np.arange(len(rows)), -score))[:10]
        assert got[got.query_id == q].id.tolist() == want.tolist()


def test_best_rows_keep_ties_and_repeated_names():
    best = R._Best(2, 2)
    best.add(np.array([[1.0, 3.0, 3.0], [0.0, 2.0, 1.0]]), np.array([9, 5, 4]), 0.0)
    best.add(np.array([[3.0, 0.5], [2.0, 2.0]]), np.array([9, 9]), 0.0)
    q, name, score = best.cut()
    assert list(zip(q.tolist(), name.tolist(), score.tolist(), strict=True)) == [(0, 4, 3.0), (0, 5, 3.0), (1, 5, 2.0), (1, 9, 2.0)]


def test_batches_to_python_are_bounded(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    c = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    R.vector_topk(c, c.selectExpr("chunk_id AS query_id", "embedding AS vector"), 1)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_keyword_scores_shuffle_no_words_that_are_not_asked(spark):
    chunks = spark.createDataFrame([(k, k, f"river w{k} x{k} stone") for k in range(50)], "chunk_id long, note_id long, content string")
    terms = spark.createDataFrame([(1, "river", 1.0), (1, "stone", 1.0)], "query_id int, term string, weight double")
    scores = R.bm25_scores(chunks, terms)
    assert any("/postings-" in f for f in scores.inputFiles())  # counted where chunks are read, in a written table
    assert scores.count() == 50


def test_term_counts_of_rows_and_of_repeated_notes(spark):
    rows = [(1, "river river stone"), (2, "stone light"), (2, "stone stone stone"), (None, "light"), (None, "light river"), (3, None), (4, "")]
    want = {"river": (2, 3, 2), "stone": (2, 5, 4), "light": (2, 3, 2)}
    docs = spark.createDataFrame(rows, "note_id long, content string")
    assert {r.term: (r.df, r.tf, r.most) for r in R.term_stats(docs).collect()} == want
    got = R.term_stats(docs.filter("note_id = 1"))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan  # counted where rows are read
    assert {r.term: (r.df, r.tf, r.most) for r in got.collect()} == {"river": (1, 2, 2), "stone": (1, 1, 1)}
    assert R.term_stats(docs.limit(0)).count() == 0


def test_text_operators_bound_their_batches(spark):
    from quillmesh.operators import chunk, imports, links

    notes = spark.createDataFrame([("p", "t", "a b")], "path string, title string, content string")
    for run in (chunk.chunk_notes, imports.generate_queries, links.extract_anchors):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
        run(notes)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
