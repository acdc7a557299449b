"""Registered queries of retrieval: vectors, BM25, aggregation, fusion, rerank."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import ann
from ..operators import retrieve as R
from ..session import table
from .common import docs, tidy
from .texts import tok

QUERIES, SQL = {}, {}


#: Shares of scores of six digits have seven, so queries of such round there: at six, ties would be broken by each engine.
def query(name: str, sql: str | None = None, digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf), digits)
        if sql:
            SQL[name] = sql
        return f

    return keep


SIM = "round(greatest(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0), 6)"


def chunks_of(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_queries(spark, sf, where: str):
    return table(spark, sf, "embeddings").filter(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("vector_topk", f"SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {SIM} AS similarity, row_number() OVER (ORDER BY {SIM} DESC, c.vec_id) AS rank FROM embeddings c, (SELECT * FROM embeddings WHERE vec_id = 0) q ORDER BY rank LIMIT 20")
def vector_topk(spark, sf):
    return R.vector_topk(chunks_of(spark, sf), vector_queries(spark, sf, "vec_id = 0"), 20)


BATCH = f"""SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {SIM} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, c.vec_id) AS rank FROM embeddings c, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 10"""


@query("vector_topk_batch", BATCH)
def vector_topk_batch(spark, sf):
    return R.vector_topk(chunks_of(spark, sf), vector_queries(spark, sf, "vec_id % 20 = 0"), 10)


def ann_index(spark, sf):
    """The inverted file of all embeddings and its quantizer."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    quantizer = ann.train(rows)
    return ann.build(rows, quantizer), quantizer


@query("ann_exact", BATCH.replace("chunk_id", "id"))
def ann_exact(spark, sf):
    return ann.search(*ann_index(spark, sf), vector_queries(spark, sf, "vec_id % 20 = 0"), 10)


@query("ann_topk")
def ann_topk(spark, sf):
    index, quantizer = ann_index(spark, sf)
    asked = vector_queries(spark, sf, "vec_id % 20 = 0")
    return ann.search(index, quantizer, asked, 10, probes=ann.tuned_probes(index, quantizer, asked, 10))


@query("vector_label_knn", f"""WITH h AS ({BATCH}), v AS (SELECT query_id, e.label, count(*) AS votes, sum(similarity) AS s FROM h JOIN embeddings e ON e.vec_id = chunk_id WHERE chunk_id <> query_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, round(s, 6) DESC, label) AS r FROM v) SELECT query_id, CAST(label AS BIGINT) AS label, votes FROM r WHERE r = 1""")
def vector_label_knn(spark, sf):
    hits = vector_topk_batch(spark, sf).filter("chunk_id <> query_id")
    votes = hits.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"), F.round(F.sum("similarity"), 6).alias("s"))
    return votes.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("votes"), F.desc("s"), "label"))).filter("r = 1").select("query_id", "label", "votes")


@query("vector_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first, 1.0::DOUBLE AS unit FROM embeddings")
def vector_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.norm("embedding").alias("norm"), V.l2_normalize("embedding").alias("u"))
    return e.select("vec_id", "norm", F.element_at("u", 1).alias("first"), V.norm("u").alias("unit"))


@query("cosine_neighbours", "SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 6) AS cosine, round(greatest(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_neighbours(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.join(o, "vec_id").select(F.col("vec_id").alias("a"), "b", V.cosine("embedding", "other").alias("cosine"), V.clipped_dot("embedding", "other").alias("dot"))


def bm25_sql(queries: str) -> str:
    return f"""d AS (SELECT doc_id AS note_id, length(text) AS len, {tok('text')} AS t FROM documents), st AS (SELECT count(DISTINCT note_id) AS n, avg(len) AS mean_len FROM d),
q AS ({queries}), words AS (SELECT note_id, len, unnest(t) AS term FROM d), post AS (SELECT note_id, len, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(DISTINCT note_id) AS df FROM post GROUP BY term),
scores AS (SELECT query_id, note_id, round(sum(weight * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_len)))), 6) AS score FROM q JOIN post USING (term) JOIN df USING (term), st GROUP BY query_id, note_id)"""


ONE = "SELECT 1::BIGINT AS query_id, unnest(['the', 'license', 'que', 'und']) AS term, 1.0::DOUBLE AS weight"
MANY = f"SELECT DISTINCT item_id AS query_id, unnest({tok('text')}) AS term, 1.0::DOUBLE AS weight FROM benchmark"
TOP = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id) AS rank FROM scores QUALIFY rank <= {k}"


def bm25_docs(spark, sf):
    return docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("note_id"), F.col("text").alias("content"))


def bench_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("bm25_topk", f"WITH {bm25_sql(ONE)} " + TOP.format(k=20))
def bm25_topk(spark, sf):
    terms = spark.createDataFrame([(1, t, 1.0) for t in ("the", "license", "que", "und")], "query_id int, term string, weight double")
    return R.bm25_best(bm25_docs(spark, sf), terms, 20)


@query("bm25_batch", f"WITH {bm25_sql(MANY)} " + TOP.format(k=10))
def bm25_batch(spark, sf):
    return R.bm25_best(bm25_docs(spark, sf), R.query_terms(bench_queries(spark, sf)), 10)


@query("postings_stats", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, max(tf) AS most FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def postings_stats(spark, sf):
    return R.term_stats(bm25_docs(spark, sf))


@query("keyword_normalized", f"WITH {bm25_sql(MANY)} SELECT query_id, note_id, score, round(score / greatest(max(score) OVER (PARTITION BY query_id), 0.001), 6) AS normalized FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id) <= 10")
def keyword_normalized(spark, sf):
    return R.max_normalize(R.bm25_best(bm25_docs(spark, sf), R.query_terms(bench_queries(spark, sf)), 10).drop("rank"))


@query("note_aggregate_max", f"WITH h AS ({BATCH}) SELECT query_id, chunk_id // 5 AS note_id, max(similarity) AS base_score, string_agg(CAST(chunk_id % 5 AS VARCHAR), ',' ORDER BY similarity DESC, chunk_id % 5) AS chunks FROM h GROUP BY ALL")
def note_aggregate_max(spark, sf):
    hits = vector_topk_batch(spark, sf).select("query_id", F.floor(F.col("chunk_id") / 5).alias("note_id"), (F.col("chunk_id") % 5).alias("chunk_index"), F.col("similarity").alias("score"))
    return R.note_aggregate(hits).select("query_id", "note_id", "base_score", F.array_join(F.transform("chunks", lambda c: c.cast("string")), ",").alias("chunks"))


HYBRID = f"""vec AS (SELECT query_id // 20 AS query_id, chunk_id AS note_id, similarity AS score FROM ({BATCH})),
top AS (SELECT query_id, note_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id) AS rank FROM scores) WHERE rank <= 30),
kw AS (SELECT query_id, note_id, score / greatest(max(score) OVER (PARTITION BY query_id), 0.001) AS kw FROM top),
fused AS (SELECT coalesce(vec.query_id, kw.query_id) AS query_id, coalesce(vec.note_id, kw.note_id) AS note_id, coalesce(vec.score, 0) AS vector_score, coalesce(kw, 0) AS keyword_score, 0.9::DOUBLE * coalesce(vec.score, 0) + 0.1::DOUBLE * coalesce(kw, 0) AS score FROM vec FULL JOIN kw ON vec.query_id = kw.query_id AND vec.note_id = kw.note_id)"""


def fused(spark, sf):
    vec = vector_topk_batch(spark, sf).select(F.floor(F.col("query_id") / 20).alias("query_id"), F.col("chunk_id").alias("note_id"), F.col("similarity").alias("score"))
    kw = R.bm25_best(bm25_docs(spark, sf), R.query_terms(bench_queries(spark, sf)), 30).drop("rank")
    return R.hybrid_fuse(vec, kw)


@query("hybrid_chunks", f"""WITH b AS ({BATCH}), v AS (SELECT query_id, chunk_id // 4 AS note_id, chunk_id % 4 AS chunk_index, similarity AS score FROM b),
k0 AS (SELECT q.vec_id AS query_id, c.vec_id // 4 AS note_id, c.vec_id % 4 AS chunk_index, 1.0::DOUBLE + c.vec_id % 13 AS score FROM embeddings c JOIN embeddings q ON q.vec_id % 20 = 0 AND q.label = c.label AND (c.vec_id * 7 + q.vec_id) % 9 = 0),
k AS (SELECT query_id, note_id, chunk_index, score / max(score) OVER (PARTITION BY query_id) AS score FROM k0),
c AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.note_id, k.note_id) AS note_id, coalesce(v.chunk_index, k.chunk_index) AS chunk_index, v.score AS v, k.score AS k FROM v FULL JOIN k ON v.query_id = k.query_id AND v.note_id = k.note_id AND v.chunk_index = k.chunk_index)
SELECT query_id, note_id, coalesce(max(v), 0) AS vector_score, round(coalesce(max(k), 0), 7) AS keyword_score, round(0.9::DOUBLE * coalesce(max(v), 0) + 0.1::DOUBLE * coalesce(max(k), 0), 7) AS score, string_agg(chunk_index::VARCHAR, ',' ORDER BY coalesce(v, k) DESC, chunk_index) AS chunks FROM c GROUP BY query_id, note_id""", digits=7)
def hybrid_chunks(spark, sf):
    at = lambda c: (F.floor(F.col(c) / 4).alias("note_id"), (F.col(c) % 4).alias("chunk_index"))
    vec = vector_topk_batch(spark, sf).select("query_id", *at("chunk_id"), F.col("similarity").alias("score"))
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    kw = e.join(q, "label").filter((F.col("vec_id") * 7 + F.col("query_id")) % 9 == 0).select("query_id", *at("vec_id"), (1.0 + F.col("vec_id") % 13).alias("score"))
    return R.hybrid_chunks(vec, kw).withColumn("chunks", F.array_join(F.transform("chunks", lambda c: c["chunk_index"].cast("string")), ","))


@query("hybrid_fuse", f"WITH {bm25_sql(MANY)}, {HYBRID} SELECT query_id, note_id, round(vector_score, 7) AS vector_score, round(keyword_score, 7) AS keyword_score, round(score, 7) AS score FROM fused", digits=7)
def hybrid_fuse(spark, sf):
    return fused(spark, sf)


@query("hybrid_topk", f"WITH {bm25_sql(MANY)}, {HYBRID} SELECT query_id, note_id, round(score, 7) AS base_score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, note_id) AS rank FROM fused WHERE score >= 0.05 QUALIFY rank <= 10", digits=7)
def hybrid_topk(spark, sf):
    f = fused(spark, sf).filter("score >= 0.05").withColumn("base_score", F.round("score", 7)).withColumn("final_score", F.col("base_score"))
    return R.finish(f, 0.0, 10).select("query_id", "note_id", "base_score", "rank")


@query("fast_path_split", f"SELECT *, max(similarity) OVER (PARTITION BY query_id) > 0.85 AS fast FROM ({BATCH})")
def fast_path_split(spark, sf):
    return R.fast_path(vector_topk_batch(spark, sf))


@query("confidence", f"SELECT query_id, chunk_id, round(0.5::DOUBLE * least(greatest(similarity, 0), 1) + 0.3::DOUBLE * least(rank / 10.0::DOUBLE, 1) + 0.2::DOUBLE * least(chunk_id / 500.0::DOUBLE, 1), 7) AS confidence FROM ({BATCH})", digits=7)
def confidence(spark, sf):
    return vector_topk_batch(spark, sf).select("query_id", "chunk_id", V.confidence("similarity", F.col("rank") / 10.0, F.col("chunk_id") / 500.0).alias("confidence"))


@query("rerank_blend", f"""WITH h AS (SELECT query_id, chunk_id AS note_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS original_rank FROM ({BATCH})),
j AS (SELECT *, CASE WHEN note_id % 4 <> 0 THEN least(greatest(note_id % 14 - 2, 0), 10) ELSE 0 END AS judged FROM h),
b AS (SELECT *, round(CASE WHEN original_rank <= 5 AND judged > 0 THEN 0.07::DOUBLE * judged + 0.3::DOUBLE * similarity ELSE similarity END, 7) AS s FROM j)
SELECT query_id, note_id, original_rank, s AS reranked_score, row_number() OVER (PARTITION BY query_id ORDER BY original_rank > 5, s DESC, original_rank) AS rank FROM b""", digits=7)
def rerank_blend(spark, sf):
    hits = vector_topk_batch(spark, sf).select("query_id", F.col("chunk_id").alias("note_id"), F.col("similarity").alias("final_score"))
    judged = F.when(F.col("note_id") % 4 != 0, (F.col("note_id") % 14 - 2).cast("double"))
    return R.rerank_blend(hits, judged, 5).select("query_id", "note_id", "original_rank", "reranked_score", "rank")


@query("hybrid_fast_path", f"""WITH {bm25_sql(MANY)}, {HYBRID.replace('rank <= 30', 'rank <= 15').replace(f'FROM ({BATCH})', f'FROM ({BATCH}) WHERE chunk_id <> query_id')}, m AS (SELECT query_id, max(score) > 0.6 AS fast FROM vec GROUP BY query_id)
SELECT fused.query_id, note_id, round(vector_score, 7) AS vector_score, CASE WHEN fast THEN 0 ELSE round(keyword_score, 7) END AS keyword_score, round(CASE WHEN fast THEN vector_score ELSE score END, 7) AS score, coalesce(fast, false) AS fast
FROM fused LEFT JOIN m USING (query_id) WHERE NOT coalesce(fast, false) OR vector_score > 0""", digits=7)
def hybrid_fast_path(spark, sf):
    vec = vector_topk_batch(spark, sf).filter("chunk_id <> query_id").select(F.floor(F.col("query_id") / 20).alias("query_id"), F.col("chunk_id").alias("note_id"), F.col("similarity").alias("score"))
    return R.hybrid_search(vec, bm25_docs(spark, sf), R.query_terms(bench_queries(spark, sf)), 5, threshold=0.6)
