"""An approximate vector index: an inverted file with product codes, exact scores of the best, and an exact way.

Vectors are taken to unit length, so cosine is their product. Each belongs to the list of its nearest centre; what is left of
it is cut into parts, each known by the nearest of 256 words. A query asks its nearest lists, estimates every member from a
table of its products with the words, and scores the best estimates by their own vectors. Centres and words are learned
from a bounded sample of rows; every row is in the index.

Lists may be of any size: a list's members are dealt in parts, and each part meets the queries that ask the list, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, materialize

#: Rows of which centres and words are learned, members of a list and queries that meet in a task.
SAMPLE, PART_ROWS, QUERY_ROWS = 20_000, 20_000, 5_000
#: Members and queries that meet in a task of the exact way.
EXACT_ROWS, EXACT_QUERIES = 40_000, 40_000
#: More than scores of unit vectors in single precision are off, and scores rounded to six digits.
ROUGH = 1e-4
INDEX = "id long, list int, deal int, code binary, vector binary"


@dataclass(frozen=True)
class Quantizer:
    """centres: lists x dimensions; words: parts x 256 x dimensions of a part (the last is filled up with zeros)."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def padded(self) -> int:
        return self.words.shape[0] * self.words.shape[2]

    def pad(self, m: np.ndarray) -> np.ndarray:
        return np.pad(m, ((0, 0), (0, self.padded - m.shape[1])))

    def lists(self, m: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest lists of each row, nearest first; of equally near ones the first."""
        near = nearness(m, self.centres)
        return np.argsort(-near, axis=1, kind="stable")[:, :n]

    def encode(self, m: np.ndarray, of: np.ndarray) -> np.ndarray:
        rest = self.pad(m - self.centres[of]).reshape(len(m), *self.words.shape[::2])
        return np.stack([nearness(rest[:, p], self.words[p]).argmax(axis=1) for p in range(len(self.words))], axis=1).astype(np.uint8)

    def estimates(self, query: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Products of a query with members of a list, from their codes."""
        table = np.einsum("pwd,pd->pw", self.words, self.pad(query[None])[0].reshape(self.words.shape[0], -1))
        return query @ self.centres[of] + table[np.arange(len(table)), codes].sum(axis=1)


def nearness(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Larger where nearer: half the squared distance, less what is the row's own."""
    return m @ centres.T - (centres * centres).sum(axis=1) / 2


def unit(vectors: list | pd.Series) -> np.ndarray:
    """Rows of unit length; zero vectors stay."""
    m = np.array([np.asarray(v, np.float64) for v in vectors], np.float64).reshape(len(vectors), -1)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length > 0, length, 1)


def means(m: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k centres of the rows by Lloyd's rounds; a centre that has none becomes a row again. Fewer rows are repeated."""
    r = np.random.default_rng(seed)
    centres = m[r.permutation(len(m))[:k]] if len(m) >= k else m[np.arange(k) % len(m)]
    for _ in range(rounds if len(m) > k else 0):
        of = nearness(m, centres).argmax(axis=1)
        counts = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, m)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], m[r.integers(0, len(m), k)])
    return centres


def train(vectors: DataFrame, *, lists: int | None = None, parts: int = 16, sample: int = SAMPLE, seed: int = 7) -> Quantizer:
    """A quantizer from at most `sample` rows of vectors (id, vector), those of least hash of the id. lists: by default the
    square root of the number of rows, 4,096 at most. Rows without a vector are left out; without any there is one list."""
    some = vectors.filter("vector is not null").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("vector").collect()
    if not some:
        return Quantizer(np.zeros((1, 0)), np.zeros((1, 256, 0)))
    m = unit([r.vector for r in some])
    n = lists or max(1, min(4096, int(np.sqrt(vectors.count()))))
    centres = means(m, n, seed)
    rest = m - centres[nearness(m, centres).argmax(axis=1)]
    parts = min(parts, m.shape[1])
    size = -(-m.shape[1] // parts)
    parts = -(-m.shape[1] // size)
    cut = np.pad(rest, ((0, 0), (0, parts * size - m.shape[1]))).reshape(len(m), parts, size)
    return Quantizer(centres, np.stack([means(cut[:, p], 256, seed + p + 1) for p in range(parts)]))


def build(vectors: DataFrame, quantizer: Quantizer) -> DataFrame:
    """The index (see INDEX) of all rows (id, vector) that have a vector; sizes that differ from the quantizer's are an error."""
    bound_batches(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(quantizer)

    def run(batches):
        q = shared.value
        for b in batches:
            if not len(b):
                continue
            m = unit(b["vector"])
            if m.shape[1] != q.centres.shape[1]:
                raise ValueError(f"vectors differ in size: {m.shape[1]} and {q.centres.shape[1]}")
            of = q.lists(m)[:, 0]
            yield pd.DataFrame({"id": b["id"], "list": of.astype(np.int32), "code": [c.tobytes() for c in q.encode(m, of)], "vector": [v.tobytes() for v in m]})

    rows = vectors.select(F.col("id").cast("long").alias("id"), "vector").filter("id is not null and vector is not null")
    coded = rows.mapInPandas(run, "id long, list int, code binary, vector binary")
    deals = F.greatest(F.ceil(F.count("*") / PART_ROWS), F.lit(1))
    sizes = coded.groupBy("list").agg(deals.cast("int").alias("deals"))
    return coded.join(F.broadcast(sizes), "list").select("id", "list", F.pmod(F.xxhash64("id"), F.col("deals")).cast("int").alias("deal"), "code", "vector")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(queries: DataFrame) -> DataFrame:
    """Queries over all tasks: a small table is one file, but each row is much work."""
    return queries.repartition(_partitions(queries), "query_id")


def _units(vectors: DataFrame, name: str, width: int | None) -> DataFrame:
    """(name, unit): vectors (name, vector) as bytes of unit length."""

    def run(batches):
        for b in batches:
            if len(b) and width != 0:  # of nothing learned, so nothing is in the index
                sizes = sorted({len(v) for v in b["vector"]} | ({width} if width else set()))
                if len(sizes) > 1:
                    raise ValueError(f"vectors differ in size: {' and '.join(map(str, sizes))}")
                yield pd.DataFrame({name: b[name], "unit": [v.tobytes() for v in unit(b["vector"])]})

    bound_batches(vectors.sparkSession)
    return vectors.mapInPandas(run, f"{name} long, unit binary")


def _rows(units: pd.Series) -> np.ndarray:
    if len(sizes := {len(v) for v in units}) > 1:
        raise ValueError(f"vectors differ in size: {' and '.join(str(n // 8) for n in sorted(sizes))}")
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _near(asked: np.ndarray, names: np.ndarray, members: np.ndarray, ids: np.ndarray, k: int, least: float) -> Iterator[pd.DataFrame]:
    """Each query's k best members of at least `least`. Scores of single precision, which are off by less than ROUGH, tell which pairs are scored."""
    from .retrieve import CELLS, _Best

    if asked.shape[1] != members.shape[1]:
        raise ValueError(f"vectors differ in size: {asked.shape[1]} and {members.shape[1]}")
    rough = members.astype(np.float32)
    for a in range(0, len(names), 1024):
        own = asked[a : a + 1024]
        best, some, single = _Best(len(own), k), max(1, CELLS // len(own)), own.astype(np.float32)
        for start in range(0, len(ids), some):
            guess = single @ rough[start : start + some].T
            if least <= 0:
                np.maximum(guess, 0, out=guess)
            bar = (np.maximum(best.floor, least) - ROUGH).astype(np.float32)
            q, r = np.divmod(np.flatnonzero(guess >= bar[:, None]), guess.shape[1])
            r += start
            score = np.empty(len(q))
            for x in range(0, len(q), 1 << 16):  # their vectors, a bounded number at once
                y = slice(x, x + (1 << 16))
                score[y] = np.einsum("ij,ij->i", own[q[y]], members[r[y]])
            score = np.round(np.maximum(score, 0), 6)
            kept = (score >= best.floor[q]) & (score >= least)
            best.held.append((q[kept], ids[r[kept]], score[kept]))
            best.size += int(kept.sum())
            if not start or best.size > 4 * k * len(own) + 100_000:
                best.cut()
        q, name, score = best.cut()
        yield pd.DataFrame({"query_id": names[a + q], "id": name, "similarity": score})


def _met(members: DataFrame, asked: DataFrame, k: int, least: float) -> DataFrame:
    """query_id, id, similarity: the k best of at least `least` that each part of the members (id, unit) has for each query (query_id, unit)."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [*_near(_rows(left["unit"]), left["query_id"].to_numpy(np.int64), _rows(right["unit"]), right["id"].to_numpy(np.int64), k, least)] if len(left) and len(right) else []
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "similarity": []}).astype({"query_id": int, "id": int})

    parts, blocks = (max(1, -(-df.count() // n)) for df, n in ((members, EXACT_ROWS), (asked, EXACT_QUERIES)))
    while parts * blocks < _partitions(members):  # few, but much work each
        parts, blocks = (parts + 1, blocks) if parts <= blocks else (parts, blocks + 1)
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", place("query_id", blocks)).withColumn("part", every_of(parts))
    right = members.withColumn("part", place("id", parts)).withColumn("block", every_of(blocks))
    keys, stated = ["block", "part"], 2 * parts * blocks
    return left.repartition(stated, *keys).groupBy(*keys).cogroup(right.repartition(stated, *keys).groupBy(*keys)).applyInPandas(meet, "query_id long, id long, similarity double")


def _asked(queries: DataFrame, width: int | None) -> DataFrame:
    some = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").filter("query_id is not null and vector is not null")
    return materialize(_units(_dealt(some), "query_id", width), "asked")


def exact(vectors: DataFrame, queries: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """query_id, id, similarity, rank: the k rows of vectors (id, vector) of highest cosine (at least 0, to six digits; ties by
    smaller id) for each query (query_id, vector), of those whose cosine is `least` or more. Every row counts; no index is made.

    Equal vectors meet a query once, under the least of their ids: only the k least ids of a vector can be among its k best. An
    id of several vectors, which counts by its nearest one, stands for itself.
    """
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vector").filter("id is not null and vector is not null").distinct()
    rows = rows.withColumn("own", F.when(F.count("*").over(Window.partitionBy("id")) > 1, F.col("id")))
    same = Window.partitionBy("vector", "own").orderBy("id")
    rows = rows.withColumns({"n": F.row_number().over(same), "head": F.first("id").over(same)}).filter(F.col("n") <= k)
    rows = materialize(rows, "members")
    heads = materialize(_units(rows.filter("n = 1").select("id", "vector"), "id", None), "heads")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    first = _met(heads, _asked(queries, None), k, least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    found = first.select("query_id", F.col("id").alias("head"), "similarity").join(rows.select("head", "id").distinct(), "head")
    return found.select("query_id", "id", "similarity").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _exact(index: DataFrame, quantizer: Quantizer, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, similarity: each query's k best of every part of the index, by scores of every member."""
    members = materialize(index.select("id", F.col("vector").alias("unit")), "members")  # they are counted first
    return _met(members, _asked(queries, quantizer.centres.shape[1]), k, 0.0)


def search(index: DataFrame, quantizer: Quantizer, queries: DataFrame, k: int, *, probes: int | None = None, rerank: int = 200) -> DataFrame:
    """query_id, id, similarity, rank: the k members of highest cosine (at least 0, to six digits; ties by smaller id) of those
    that each query's `probes` nearest lists hold and whose estimate is among the `rerank` best of their part.

    With probes None every member is scored, which is the exact way: parts of the index meet blocks of queries, whatever the
    lists, and a task holds a bounded number of scores. queries: query_id, vector; a query without a vector has no rows.
    Each task hands on k rows a query.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    if probes is None:
        return _exact(index, quantizer, queries, k).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    bound_batches(index.sparkSession)
    shared = index.sparkSession.sparkContext.broadcast(quantizer)
    n = min(probes, len(quantizer.centres))

    def ask(batches):
        q = shared.value
        for b in batches:
            if len(b):
                m = unit(b["vector"])
                if not q.centres.shape[1]:  # learned of nothing, so nothing is in the index
                    continue
                if m.shape[1] != q.centres.shape[1]:
                    raise ValueError(f"vectors differ in size: {m.shape[1]} and {q.centres.shape[1]}")
                yield pd.DataFrame({"query_id": b["query_id"], "lists": list(q.lists(m, n).astype(np.int32)), "asked": [v.tobytes() for v in m]})

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q, out = shared.value, []
        if len(left) and len(right):
            vectors = np.frombuffer(b"".join(right["vector"]), np.float64).reshape(len(right), -1)
            codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
            ids, of = right["id"].to_numpy(), int(right["list"][0])
            for name, raw in zip(left["query_id"], left["asked"], strict=True):
                v = np.frombuffer(raw, np.float64)
                best = np.arange(len(ids))
                if len(ids) > rerank:
                    best = np.argpartition(-q.estimates(v, of, codes), rerank - 1)[:rerank]
                score = np.round(np.maximum(vectors[best] @ v, 0), 6)
                first = np.lexsort((ids[best], -score))[:k]
                out.append(pd.DataFrame({"query_id": np.full(len(first), name), "id": ids[best[first]], "similarity": score[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "similarity": []}).astype({"query_id": int, "id": int})

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").filter("query_id is not null and vector is not null")
    asked = _dealt(asked).mapInPandas(ask, "query_id long, lists array<int>, asked binary").select("query_id", F.explode("lists").alias("list"), "asked")
    parts = index.groupBy("list").agg((F.max("deal") + 1).alias("deals"))
    asks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    both = F.broadcast(parts.join(asks, "list"))
    every_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(both, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("deal", every_of("deals")).select("query_id", "list", "asked", "block", "deal")
    right = index.join(both, "list").withColumn("block", every_of("blocks")).select("id", "list", "code", "vector", "block", "deal")
    keys = ["list", "deal", "block"]
    # Few bytes but much work a row: a stated number of partitions is not merged into fewer.
    stated = max(len(quantizer.centres), _partitions(index))
    found = left.repartition(stated, *keys).groupBy(*keys).cogroup(right.repartition(stated, *keys).groupBy(*keys)).applyInPandas(meet, "query_id long, id long, similarity double")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The part of the rows of an exact search that another has found; 1 if there are none."""
    one = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.count("hit").alias("hits"), F.count("*").alias("rows")).first()
    return one.hits / one.rows if one.rows else 1.0


def tuned_probes(index: DataFrame, quantizer: Quantizer, queries: DataFrame, k: int, *, target: float = 0.95, sample: int = 200, rerank: int = 200) -> int:
    """The least of 1, 2, 4, ... lists to ask by which the first `sample` queries (by hash) find `target` of their exact k."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    exact, probes = search(index, quantizer, some, k).cache(), 1
    try:
        while probes < len(quantizer.centres) and recall(search(index, quantizer, some, k, probes=probes, rerank=rerank), exact) < target:
            probes *= 2
    finally:
        exact.unpersist()
    return min(probes, len(quantizer.centres))
