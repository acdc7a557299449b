"""Retrieval, batched over many queries: vector top-K, BM25, note aggregation, fusion and the fast path.

A single query is the one-row case. Chunks have chunk_id, note_id, content and embedding; queries have query_id and
text or vector. Per-query maxima and ranks are windows over query_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import bound_batches, materialize

K1, B = 1.2, 0.75
#: Queries that travel with the tasks at once; more are done in blocks of so many.
QUERY_BLOCK, TERM_BLOCK = 2048, 256
#: Distinct words of all queries that travel with the tasks; more are joined.
ASKED_MOST = 200_000
#: Scores that a task holds at once.
CELLS = 1 << 20


def _blocks(rows: DataFrame, key: str, size: int):
    """Rows in order of a key, in lists that end where the key changes after `size` keys; the driver holds one at a time."""
    held, names = [], set()
    for r in rows.orderBy(key).toLocalIterator():
        if r[key] not in names and len(names) == size:
            yield held
            held, names = [], set()
        names.add(r[key])
        held.append(r)
    yield held


def _over_blocks(blocks, run) -> DataFrame:
    """run(block) of every block: of a single one as it is, of more as written tables, one after another."""
    found = last = None
    for block in blocks:
        if last is not None:
            done = materialize(run(last), "topk")
            found = done if found is None else found.union(done)
        last = block
    return run(last) if found is None else found.union(run(last))


class _Best:
    """The k best rows of each query so far, by score and then by name; it holds a few times k rows a query at most."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor, self.size = k, np.full(queries, -np.inf), 0
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, scores: np.ndarray, names: np.ndarray, least: float = -np.inf) -> None:
        """Scores of queries x rows, CELLS of them or one row of each query."""
        q, r = np.nonzero((scores >= self.floor[:, None]) & (scores > least))
        self.held.append((q, names[r], scores[q, r]))
        self.size += len(q)
        if self.size > 4 * self.k * len(self.floor) + 100_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query places, names and scores of the best, best first; a name counts once for a query, by its best score."""
        q, name, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        q, name, score = (x[np.lexsort((-score, name, q))] for x in (q, name, score))
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (name[1:] != name[:-1])
        q, name, score = q[once], name[once], score[once]
        q, name, score = (x[np.lexsort((name, -score, q))] for x in (q, name, score))
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.floor[q[place == self.k - 1]] = score[place == self.k - 1]
        q, name, score = q[place < self.k], name[place < self.k], score[place < self.k]
        self.held, self.size = [(q, name, score)], 0
        return q, name, score


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, id, similarity and rank of each query's k most similar chunks; ties go to the smaller id.

    Queries (query_id, vector) are taken in blocks of QUERY_BLOCK, of which the driver holds one; each task keeps the k best
    of what it scans, CELLS scores at a time, so only k rows a query and task are shuffled. Similarity is the cosine, at least 0, 0 for zero vectors;
    rounded to 1e-6 before ranking, so that the order of additions doesn't matter. Chunks and queries without a vector are left
    out; an empty side gives no rows.
    """

    def block(rows: list) -> DataFrame:
        ids = np.array([r["query_id"] for r in rows], np.int64)
        m = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return _topk_block(chunks, ids, m / np.where(length > 0, length, 1), k, id_col, vec_col)

    found = _over_blocks(_blocks(queries.select("query_id", "vector").filter("query_id is not null and vector is not null"), "query_id", QUERY_BLOCK), block)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _scan(batches, ids: np.ndarray, unit: np.ndarray, k: int, id_col: str, vec_col: str):
    """The k best rows of Arrow batches for each query; unit: the queries' vectors, of unit length."""
    best, some = _Best(len(ids), k), max(1, CELLS // max(len(ids), 1))
    for b in batches:
        if not b.num_rows or not len(ids):
            continue
        names, every = b.column(id_col).to_numpy(), b.column(vec_col).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        if every.shape[1] != unit.shape[1]:
            raise ValueError(f"vectors differ in size: {every.shape[1]} and {unit.shape[1]}")
        for start in range(0, b.num_rows, some):
            m = every[start : start + some].astype(np.float64)
            length = np.sqrt((m * m).sum(axis=1))
            scores = unit @ m.T
            scores /= np.where(length > 0, length, 1)
            best.add(np.round(np.maximum(scores, 0, out=scores), 6, out=scores), names[start : start + some])
    q, name, score = best.cut()
    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(name.astype(np.int64)), pa.array(score)], names=["query_id", id_col, "similarity"])


def _topk_block(chunks: DataFrame, ids: np.ndarray, unit: np.ndarray, k: int, id_col: str, vec_col: str) -> DataFrame:
    bound_batches(chunks.sparkSession)
    rows = chunks.select(F.col(id_col).cast("long").alias(id_col), vec_col).filter(F.col(vec_col).isNotNull())
    return rows.mapInArrow(lambda batches: _scan(batches, ids, unit, k, id_col, vec_col), f"query_id long, {id_col} long, similarity double")


def postings(chunks: DataFrame, id_col: str = "chunk_id", note_col: str = "note_id", text_col: str = "content") -> DataFrame:
    """term, chunk, note, tf and the chunk's length in code points."""
    words = chunks.select(id_col, note_col, F.length(text_col).alias("len"), F.explode(T.tokenize(text_col)).alias("term"))
    return words.groupBy(id_col, note_col, "len", "term").agg(F.count("*").alias("tf"))


def term_stats(chunks: DataFrame, note_col: str = "note_id", text_col: str = "content") -> DataFrame:
    """term, df, tf, most: in how many notes a term is, how often in all, and how often in one note at most.

    A note of one row is counted where its row is read, so only what a batch of rows has of each term is shuffled. Notes of
    several rows are known by their ids, and their words are brought together.
    """
    bound_batches(chunks.sparkSession)
    texts = chunks.select(F.col(note_col).alias("note"), F.col(text_col).alias("text")).filter("text is not null")
    several = materialize(texts.groupBy("note").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("note").alias("of")), "several")
    if several.isEmpty():
        once, more = texts, None
    else:
        of = texts["note"].eqNullSafe(several["of"])
        once, more = texts.join(several, of, "left_anti"), texts.join(several, of, "left_semi")
    of_rows = once.select(T.tokenize("text").alias("t")).mapInArrow(_counted_terms, "term string, df long, tf long, most long")
    if more is not None:
        per = more.select("note", F.explode(T.tokenize("text")).alias("term")).groupBy("note", "term").agg(F.count("*").alias("n"))
        of_rows = of_rows.union(per.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"), F.max("n").alias("most")))
    return of_rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.max("most").alias("most"))


def _counted_terms(batches):
    """term, df, tf and most of each batch of rows with words t."""
    for b in batches:
        lists = b.column("t")
        sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        n = len(words.dictionary)
        pair, tf = np.unique(np.repeat(np.arange(b.num_rows), sizes) * n + words.indices.to_numpy(), return_counts=True)
        term, most = pair % max(n, 1), np.zeros(n, np.int64)
        np.maximum.at(most, term, tf)
        df, total = np.bincount(term, minlength=n), np.bincount(term, tf, n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(df.astype(np.int64)), pa.array(total), pa.array(most)], names=["term", "df", "tf", "most"])


def query_terms(queries: DataFrame, weight: float = 1.0) -> DataFrame:
    """query_id, term, weight of each query's distinct terms."""
    return queries.select("query_id", F.explode(F.array_distinct(T.tokenize("text"))).alias("term"), F.lit(weight).alias("weight"))


def bm25_scores(chunks: DataFrame, terms: DataFrame, id_col: str = "chunk_id", note_col: str = "note_id", text_col: str = "content") -> DataFrame:
    """query_id, note and score: the best chunk's sum of weighted BM25 of its terms.

    df counts notes, tf counts within a chunk, lengths are code points, and their mean is over all chunks. Only the queries'
    words are taken from a chunk, and counted there, before anything is shuffled (see _asked_postings).
    """
    one = chunks.select(F.col(id_col).alias("c"), F.col(note_col).alias("note"), F.length(text_col).alias("len"), T.tokenize(text_col).alias("t"))
    post, weighted, mean_len = _asked_postings(one, terms)
    words = post.select("c", "note", "len", F.explode(F.arrays_zip("words", "tfs")).alias("p")).select("c", "note", "len", F.col("p.words").alias("word"), F.col("p.tfs").alias("tf"))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean_len))
    chunk = words.join(weighted, "word").groupBy("query_id", "c", "note").agg(F.sum(F.col("w") * tf).alias("s"))
    return chunk.groupBy("query_id", F.col("note").alias(note_col)).agg(F.round(F.max("s"), 6).alias("score"))


def _asked_postings(one: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Of chunks (c, note, len, t) and terms (query_id, term, weight): the written table of chunks with words and tfs, arrays of
    the queries' words that each has; query_id, word and w, the weight by the word's document frequency; and the mean length.

    Chunks are tokenized once. Up to ASKED_MOST distinct words travel with the tasks, and each chunk's are counted where it
    is read; more are joined.
    """
    bound_batches(one.sparkSession)
    asked = terms.select("term").filter("term is not null").distinct()
    stats = one.agg(F.countDistinct("note").alias("n"), F.avg("len").alias("mean_len")).first()
    few = sorted(r.term for r in asked.limit(ASKED_MOST + 1).collect())
    if len(few) <= ASKED_MOST:
        post = materialize(_counted_words(one, few), "postings")
        names = terms.sparkSession.createDataFrame(list(enumerate(few)), "word int, term string")
    else:
        found = one.select("c", "note", "len", F.explode("t").alias("word")).join(asked.withColumnRenamed("term", "word"), "word", "left_semi").groupBy("c", "note", "len", "word").agg(F.count("*").cast("int").alias("tf"))
        post = materialize(found.groupBy("c", "note", "len").agg(F.collect_list("word").alias("words"), F.collect_list("tf").alias("tfs")), "postings")
        names = asked.select(F.col("term").alias("word"), "term")
    df = post.select("note", F.explode("words").alias("word")).groupBy("word").agg(F.countDistinct("note").alias("df")).join(names, "word").select("word", "term", "df")
    idf = F.log((F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return post, terms.join(df, "term").select("query_id", "word", (F.col("weight") * idf).alias("w")), stats["mean_len"] or 1.0


def _counted_words(chunks: DataFrame, asked: list[str]) -> DataFrame:
    """c, note, len, words (places in the sorted list `asked`) and tfs of chunks (c, note, len, t), where any is asked: counted
    within each chunk's own row, so nothing is shuffled. The list is of proven size, so it is broadcast."""
    shared = chunks.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        known = pa.array(shared.value, pa.string())
        for b in batches:
            lists = b.column("t")
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            pair = np.repeat(np.arange(b.num_rows), sizes) * len(known) + found
            pair, tf = np.unique(pair[found >= 0], return_counts=True)
            row = pair // max(len(known), 1)
            some, starts = np.unique(row, return_index=True)
            cuts = pa.array(np.append(starts, len(row)).astype(np.int32))
            kept = b.select(["c", "note", "len"]).take(pa.array(some))
            words = pa.ListArray.from_arrays(cuts, pa.array((pair % max(len(known), 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*kept.columns, words, pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32)))], names=["c", "note", "len", "words", "tfs"])

    kind = lambda c: chunks.schema[c].dataType.simpleString()
    return chunks.mapInArrow(run, f"c {kind('c')}, note {kind('note')}, len int, words array<int>, tfs array<int>")


def bm25_best(chunks: DataFrame, terms: DataFrame, k: int, id_col: str = "chunk_id", note_col: str = "note_id", text_col: str = "content") -> DataFrame:
    """The k best notes (long ids) of each query by bm25_scores: query_id, note, score, rank; ties go to the smaller note.

    Chunks are tokenized once: how often each has the queries' words is a written table (see _asked_postings). Then each task
    multiplies its chunks' weights with the weights of a block of queries and keeps k notes a query, so scores are not
    shuffled. Terms (query_id, term, weight) are taken in blocks of TERM_BLOCK queries, of which the driver holds one.
    """
    one = chunks.select(F.col(id_col).alias("c"), F.col(note_col).cast("long").alias("note"), F.length(text_col).alias("len"), T.tokenize(text_col).alias("t"))
    post, weighted, mean_len = _asked_postings(one, terms)

    def block(rows: list) -> DataFrame:
        queries = sorted({r["query_id"] for r in rows})
        place, own = {q: i for i, q in enumerate(queries)}, sorted({r["word"] for r in rows})
        words = {t: i for i, t in enumerate(own)}
        weights = np.zeros((len(words), len(queries)))
        for r in rows:
            weights[words[r["word"]], place[r["query_id"]]] += r["w"]

        def run(batches):
            best, known = _Best(len(queries), k), pa.array(own, pa.int32() if not own or isinstance(own[0], int) else pa.string())
            for b in batches:
                if not b.num_rows or not queries:
                    continue
                lists, notes = b.column("words"), b.column("note").to_numpy()
                size = np.repeat(b.column("len").to_numpy().astype(float), lists.value_lengths().to_numpy())
                row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
                word = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                tf = b.column("tfs").flatten().to_numpy().astype(float)
                weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_len))
                row, word, weight = row[word >= 0], word[word >= 0], weight[word >= 0]
                ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row))  # of each chunk's words
                start = 0
                while start < len(row):  # chunks of CELLS products at a time, or one
                    end = max(ends[np.searchsorted(ends, start, "right")], ends[max(np.searchsorted(ends, start + CELLS // len(queries), "right") - 1, 0)])
                    firsts = np.concatenate(([0], np.flatnonzero(np.diff(row[start:end])) + 1))
                    scores = np.add.reduceat(weights[word[start:end]] * weight[start:end, None], firsts, axis=0)
                    best.add(np.round(scores.T, 6), notes[row[start:end][firsts]], 0.0)
                    start = end
            q, name, score = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array([queries[i] for i in q], pa.int64()), pa.array(name.astype(np.int64)), pa.array(score)], names=["query_id", note_col, "score"])

        return post.mapInArrow(run, f"query_id long, {note_col} long, score double")

    scored = _over_blocks(_blocks(weighted, "query_id", TERM_BLOCK), block)
    return top_per_query(scored.groupBy("query_id", note_col).agg(F.max("score").alias("score")), k, tie=note_col)


def top_per_query(scores: DataFrame, k: int, score: str = "score", tie: str = "note_id") -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), tie))).filter(F.col("rank") <= k)


def note_aggregate(hits: DataFrame) -> DataFrame:
    """Chunk hits (query_id, note_id, chunk_index, score) as notes: best score, and chunks by score."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("chunk_index"))))
    return hits.groupBy("query_id", "note_id").agg(F.max("score").alias("base_score"), F.transform(best, lambda x: x["chunk_index"]).alias("chunks"))


def max_normalize(scores: DataFrame, score: str = "score", floor: float = 0.001) -> DataFrame:
    """Scores by their query's largest, or by floor where that is larger."""
    top = F.greatest(F.max(score).over(Window.partitionBy("query_id")), F.lit(floor))
    return scores.withColumn("normalized", F.col(score) / top)


def hybrid_fuse(vector: DataFrame, keyword: DataFrame, keyword_weight: float = 0.1) -> DataFrame:
    """(1 - w) * vector + w * keyword / largest keyword, over the notes of either; what is missing counts 0, and so does a null
    score. An empty side leaves the other's notes; hybrid_chunks also keeps their chunks."""
    kw = max_normalize(keyword.select("query_id", "note_id", "score")).select("query_id", "note_id", F.col("normalized").alias("kw"))
    both = vector.select("query_id", "note_id", F.col("score").alias("vec")).join(kw, ["query_id", "note_id"], "full_outer")
    vec, key = F.coalesce("vec", F.lit(0.0)), F.coalesce("kw", F.lit(0.0))
    return both.select("query_id", "note_id", vec.alias("vector_score"), key.alias("keyword_score"), ((1 - keyword_weight) * vec + keyword_weight * key).alias("score"))


def hybrid_chunks(vector: DataFrame, keyword: DataFrame, keyword_weight: float = 0.1) -> DataFrame:
    """query_id, note_id, vector_score, keyword_score, score, and chunks (chunk_index, score, best first): the fusion of chunk hits
    (query_id, note_id, chunk_index, score) of both searches, by note.

    Vector scores are taken between 0 and 1, keyword scores by their query's largest. A note has the chunks of both; one that
    both found has its vector score, and of a chunk that one search found more than once the best counts. Hits without a
    note, chunk or score are left out; an empty side counts 0.
    """
    some = lambda df: df.select("query_id", "note_id", "chunk_index", "score").dropna()
    by = ["query_id", "note_id", "chunk_index"]
    v = some(vector).groupBy(*by).agg(F.max(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).alias("v"))
    k = some(keyword).groupBy(*by).agg(F.max("score").alias("s"))
    top = F.max("s").over(Window.partitionBy("query_id"))
    k = k.select(*by, F.when(top > 0, F.col("s") / F.when(top > 0, top).otherwise(1.0)).otherwise(0.0).alias("k"))
    both = v.join(k, by, "full_outer").withColumn("c", F.struct((-F.coalesce("v", "k")).alias("neg"), "chunk_index"))
    note = both.groupBy("query_id", "note_id").agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("vector_score"), F.coalesce(F.max("k"), F.lit(0.0)).alias("keyword_score"), F.array_sort(F.collect_list("c")).alias("c"))
    chunks = F.transform("c", lambda x: F.struct(x["chunk_index"].alias("chunk_index"), (-x["neg"]).alias("score")))
    score = (1 - keyword_weight) * F.col("vector_score") + keyword_weight * F.col("keyword_score")
    return note.select("query_id", "note_id", "vector_score", "keyword_score", score.alias("score"), chunks.alias("chunks"))


def fast_path(hits: DataFrame, threshold: float = 0.85) -> DataFrame:
    """hits with fast: whether their query's best score is above the threshold, so that vectors alone decide."""
    return hits.withColumn("fast", F.max("similarity").over(Window.partitionBy("query_id")) > threshold)


def finish(hits: DataFrame, min_score: float = 0.3, k: int = 10) -> DataFrame:
    """Filtered by base score, ordered by final score."""
    return top_per_query(hits.filter(F.col("base_score") >= min_score), k, "final_score")


def rerank_blend(hits: DataFrame, judged: Column, top: int = 10) -> DataFrame:
    """.7 * judged / 10 + .3 * final for each query's first `top` hits, judged taken between 0 and 10.

    A hit that is unjudged (null) or judged 0 keeps its score, so where a judge fails the order stays.
    """
    ranked = hits.withColumn("original_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "note_id")))
    said = F.least(F.greatest(judged, F.lit(0.0)), F.lit(10.0))
    blend = F.when((F.col("original_rank") <= top) & (said > 0), 0.7 * said / 10 + 0.3 * F.col("final_score")).otherwise(F.col("final_score"))
    return ranked.withColumn("reranked_score", blend).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("original_rank") > top, F.desc("reranked_score"), "original_rank")))


def model_json(text: Column | str) -> Column:
    """The JSON of a model's answer: that of its fenced block, else the whole, else from the first brace or bracket to the
    last; null where none of them is JSON."""
    t = T.col(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    tries = [F.trim(fenced), F.trim(t), F.regexp_extract(t, r"(?s)\{.*\}", 0), F.regexp_extract(t, r"(?s)\[.*\]", 0)]
    return F.coalesce(*[F.when((x != "") & F.rlike(x, F.lit(r"(?s)^[\[{]")) & F.try_parse_json(x).isNotNull(), x) for x in tries])


def judged_scores(answer: Column | str, default: float = 5.0) -> Column:
    """array<struct<index, score>> of the `evaluations` in a judge's answer, index from 1; scores taken between 0 and 10, the
    default for none or 0; null for an answer without them."""
    rows = F.from_json(F.get_json_object(model_json(answer), "$.evaluations"), "array<struct<index:int,score:double>>")
    said = lambda r: F.least(F.greatest(F.coalesce(F.nullif(r["score"], F.lit(0.0)), F.lit(default)), F.lit(0.0)), F.lit(10.0))
    return F.transform(F.filter(rows, lambda r: r["index"] >= 1), lambda r: F.struct(r["index"].alias("index"), said(r).alias("score")))


def llm_rerank(hits: DataFrame, judge, top: int = 10, default: float = 5.0) -> DataFrame:
    """rerank_blend by a judge: judge(prompts: pandas Series of a query's first `top` notes as text) -> Series of answers.

    hits need query_id, note_id, final_score, title and preview. One answer a query; a note that an answer leaves out counts
    `default`; where an answer can't be read, the query's order stays.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "note_id")
    first = hits.withColumn("index", F.row_number().over(order)).filter(F.col("index") <= top)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("index", "title", "preview"))), lambda r: F.concat(F.lit("["), r["index"].cast("string"), F.lit("] "), r["title"], F.lit(": "), r["preview"]))
    ask = F.pandas_udf(judge, "string")
    said = first.groupBy("query_id").agg(F.array_join(lines, "\n").alias("prompt")).select("query_id", judged_scores(ask("prompt")).alias("said")).filter("said is not null")
    mine = F.transform(F.filter("said", lambda r: r["index"] == F.col("index")), lambda r: r["score"])
    scores = first.select("query_id", "note_id", "index").join(said, "query_id").select("query_id", "note_id", F.coalesce(F.try_element_at(mine, F.lit(-1)), F.lit(default)).alias("judged"))
    return rerank_blend(hits.join(scores, ["query_id", "note_id"], "left"), F.col("judged"), top).drop("judged")


def context_expansion(hits: DataFrame, notes: DataFrame, around: int = 3) -> DataFrame:
    """hits (note_id, content: the best chunk) with `expanded`: the note's lines (note_id, text) from `around` before the
    chunk's first place to `around` after, where that is longer than the chunk; else the chunk."""
    j = hits.join(notes.select("note_id", F.col("text").alias("_text")), "note_id", "left")
    at = F.coalesce(F.call_function("instr", F.col("_text"), F.col("content")), F.lit(0))
    lines = F.split("_text", "\n", -1)
    count = lambda t: F.size(F.split(t, "\n", -1))
    before = count(F.substring("_text", F.lit(1), at - 1))
    after = count(F.substring("_text", at + F.length("content"), F.lit(1 << 30)))
    start = F.greatest(before - around, F.lit(0))
    end = F.least(F.size(lines), before + F.least(after, F.lit(around)))
    wide = F.trim(F.array_join(F.slice(lines, start + 1, F.greatest(end + 1 - start, F.lit(0))), "\n"))
    return j.withColumn("expanded", F.when((at > 0) & (F.length(wide) > F.length("content")), wide).otherwise(F.col("content"))).drop("_text")


def hybrid_search(vector: DataFrame, chunks: DataFrame, terms: DataFrame, k: int, keyword_weight: float = 0.1, threshold: float = 0.85) -> DataFrame:
    """hybrid_fuse where a query's best vector hit (query_id, note_id, score) is not above the threshold; where it is, vectors
    alone decide, and its terms never reach the keyword search, which keeps 3 * k notes a query."""
    fast = vector.groupBy("query_id").agg(F.max("score").alias("m")).filter(F.col("m") > threshold).select("query_id")
    kw = bm25_best(chunks, terms.join(fast, "query_id", "left_anti"), 3 * k).drop("rank")
    slow = hybrid_fuse(vector.join(fast, "query_id", "left_anti"), kw, keyword_weight)
    alone = vector.join(fast, "query_id", "left_semi").select("query_id", "note_id", F.col("score").alias("vector_score"), F.lit(0.0).alias("keyword_score"), "score")
    return slow.withColumn("fast", F.lit(False)).union(alone.withColumn("fast", F.lit(True)))
