"""Hard negatives by a vector-approximation file.

The file is a written table of blocks of rows. In each dimension a block's values are cut by rank into CELLS cells, each
known by its least and greatest value; two dimensions' cells make one byte. For an anchor, the least and greatest part that
each cell can add to a score are looked up in tables, so a row's score is bounded from its bytes alone, half as many lookups
as dimensions. The rows whose bounds lie highest are scored first, and what they reach is a threshold; then only rows whose
bounds may enter the window above the threshold are scored, in integers.

Anchors meet the file in a grid: each group of anchors meets each group of blocks in one task, which reads the anchors
first, keeps the best rows of each and streams the blocks. A task hands on k rows an anchor and window at most; those are
ranked once more over all groups. The first pass finds the positives, whose scores set the windows of the second.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, forget, materialize, released

CELLS = 16
#: Blocks whose anchors make a group, and blocks of rows in a group that meets them.
ANCHOR_BLOCKS, ROW_BLOCKS = 200, 8
#: Tasks that the cells of the grid are dealt to, at most.
MOST_TASKS = 20_000
#: Anchors bounded at once against a block, and rows of highest bounds that are scored first.
CHUNK, FIRST = 64, 8
FILE = "part long, number long, ids binary, labels binary, exact binary, codes binary, lows binary, highs binary"
NONE, ALL = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def approximate(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of rows of an even number of dimensions: a byte for two of them, and each cell's least and greatest value."""
    n, d = q.shape
    order, cell = np.argsort(q, axis=0, kind="stable"), np.arange(n) * CELLS // max(n, 1)
    cells = np.zeros((n, d), np.uint8)
    np.put_along_axis(cells, order, np.broadcast_to(cell[:, None], (n, d)).astype(np.uint8), axis=0)
    ranked = np.take_along_axis(q, order, axis=0)
    lows, highs = np.zeros((CELLS, d), np.int64), np.zeros((CELLS, d), np.int64)
    used, first = np.unique(cell, return_index=True)
    lows[used], highs[used] = ranked[first], ranked[np.append(first[1:], n) - 1] if n else ranked
    return cells[:, 0::2] * CELLS + cells[:, 1::2], lows, highs


@dataclass
class Block:
    """Rows of the file: ids, labels, exact vectors, their cells' bytes and each cell's values."""

    ids: np.ndarray
    labels: np.ndarray
    exact: np.ndarray
    codes: np.ndarray
    lows: np.ndarray
    highs: np.ndarray

    def of_rows(self, at: np.ndarray) -> Block:
        return Block(self.ids[at], self.labels[at], self.exact[at], self.codes[at], self.lows, self.highs)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Between what each anchor's score with each row lies."""
        a, d = anchors.shape[0], self.lows.shape[1]
        widest = max(int(np.abs(self.lows).max(initial=0)), int(np.abs(self.highs).max(initial=0))) * int(np.abs(anchors).max(initial=0))
        kind = np.int32 if widest * d < 2**30 else np.int64
        x, y = anchors[:, :, None] * self.lows.T, anchors[:, :, None] * self.highs.T
        out = []
        for t in (np.minimum(x, y).astype(kind), np.maximum(x, y).astype(kind)):
            pairs = np.ascontiguousarray((t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(a, d // 2, CELLS * CELLS).swapaxes(0, 1))
            total = np.zeros((a, len(self.ids)), kind)
            for j in range(d // 2):
                total += np.take(pairs[j], self.codes[:, j], axis=1)
            out.append(total)
        return out[0], out[1]


def fit(q: np.ndarray, d: int) -> np.ndarray:
    """q with d dimensions; what a row lacks is zero."""
    return q if q.shape[1] == d else np.pad(q, ((0, 0), (0, d - q.shape[1])))


def best_rows(anchors: np.ndarray, block: Block, allowed: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors' numbers, rows' numbers, scores) that hold, for each anchor and window, the k first of the allowed rows whose
    score is from lo to hi, unless they score under `least`; lo, hi and least are anchors by windows, as numbers are of both."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    windows = lo.shape[1]
    low, high = block.bounds(anchors)
    middle = (low >> 1).astype(np.int64) + (high >> 1)

    def scored(a, w, r):
        s = np.einsum("ij,ij->i", anchors[a], block.exact[r])
        fits = (s >= lo[a, w]) & (s <= hi[a, w])
        return a[fits], r[fits], s[fits]

    for w in range(windows):
        floor = np.maximum(lo[:, w], least[:, w])
        maybe = allowed & (high >= floor[:, None]) & (low <= hi[:, w, None])
        if not maybe.any():
            continue
        guess = np.where(maybe & (middle <= hi[:, w, None]), middle, NONE)
        n = min(max(FIRST, k), guess.shape[1])
        top = np.argpartition(guess, guess.shape[1] - n, axis=1)[:, guess.shape[1] - n :]
        a = np.repeat(np.arange(len(anchors)), n)
        r = top.ravel()
        some = guess[a, r] > NONE
        a, _, s = scored(a[some], np.full(some.sum(), w), r[some])
        order = np.lexsort((-s, a))
        a, s = a[order], s[order]
        kth = np.flatnonzero(np.arange(len(a)) - np.searchsorted(a, a) == k - 1)
        floor[a[kth]] = np.maximum(floor[a[kth]], s[kth])
        a, r = np.nonzero(maybe & (high >= floor[:, None]))
        a, r, s = scored(a, np.full(len(a), w), r)
        keep = s >= floor[a]
        found.append((a[keep] * windows + w, r[keep], s[keep]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def first_k(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each key's k highest scores, ties by smaller id."""
    order = np.lexsort((ids, -score, key))
    sorted_keys = key[order]
    return order[np.arange(len(key)) - np.searchsorted(sorted_keys, sorted_keys) < k]


class Meeting:
    """A group of anchors and, for each window of each, the best k rows so far."""

    def __init__(self, ids, labels, vectors, lo, hi, k: int, same: bool):
        self.ids, self.labels, self.vectors, self.lo, self.hi, self.k, self.same = ids, labels, vectors, lo, hi, k, same
        self.windows = lo.shape[1]
        self.key, self.row, self.score = (np.zeros(0, np.int64),) * 3

    def least(self) -> np.ndarray:
        """The k-th score of each window that has so many."""
        out = np.full(len(self.ids) * self.windows, NONE)
        kth = np.flatnonzero(np.arange(len(self.key)) - np.searchsorted(self.key, self.key) == self.k - 1)
        out[self.key[kth]] = self.score[kth]
        return out.reshape(-1, self.windows)

    def meet(self, block: Block) -> None:
        d = max(self.vectors.shape[1], block.exact.shape[1])
        self.vectors = fit(self.vectors, d)
        block = Block(block.ids, block.labels, fit(block.exact, d), np.pad(block.codes, ((0, 0), (0, d // 2 - block.codes.shape[1]))), fit(block.lows, d), fit(block.highs, d))
        least, found = self.least(), [(self.key, self.row, self.score)]
        # A pass over the same label reads only the rows of that label, one over others all.
        parts = [(np.flatnonzero(self.labels == v), block.of_rows(block.labels == v)) for v in np.intersect1d(self.labels, block.labels)] if self.same else [(np.arange(len(self.ids)), block)]
        for own, rows in parts:
            for k in range(0, len(own), CHUNK):
                at = own[k : k + CHUNK]
                allowed = rows.ids != self.ids[at, None] if self.same else rows.labels != self.labels[at, None]
                key, row, score = best_rows(self.vectors[at], rows, allowed, self.lo[at], self.hi[at], self.k, least[at])
                found.append((at[key // self.windows] * self.windows + key % self.windows, rows.ids[row], score))
        key, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = first_k(key, score, row, self.k)
        self.key, self.row, self.score = key[keep], row[keep], score[keep]


def _file(batches):
    """mapInArrow: vec_id, label, vector -> blocks of the file."""
    part, number = TaskContext.get().partitionId(), 0
    for b in batches:
        if not b.num_rows:
            continue
        vectors, ids, labels, rows = b.column("vector"), b.column("vec_id").to_numpy(), b.column("label").to_numpy(), b.num_rows
        sizes = vectors.value_lengths().to_numpy()
        d = int(sizes.max(initial=0))
        q = np.zeros((rows, d + d % 2), np.int64)
        flat = vectors.flatten().to_numpy()
        at = np.repeat(np.arange(rows), sizes)
        q[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        codes, lows, highs = approximate(q)
        order = np.argsort(labels, kind="stable")
        parts = (ids[order], labels[order], q[order], codes[order], lows, highs)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "number": pa.array([number], pa.int64())} | {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in zip(("ids", "labels", "exact", "codes", "lows", "highs"), parts, strict=True)})
        number += 1


def _read(row: dict) -> Block:
    """A block as it was written."""
    of = lambda c, kind=np.int64: np.frombuffer(row[c], kind)
    ids = of("ids")
    exact = of("exact").reshape(len(ids), -1)
    d = exact.shape[1]
    return Block(ids, of("labels"), exact, of("codes", np.uint8).reshape(len(ids), d // 2), of("lows").reshape(CELLS, d), of("highs").reshape(CELLS, d))


def _anchors(of_id: int):
    """mapInArrow: file -> block, anchor_id, label, vector (binary) of rows whose id is divisible by of_id."""

    def run(batches):
        for b in batches:
            for row in b.select(["block", "ids", "labels", "exact"]).to_pylist():
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                exact = np.frombuffer(row["exact"], np.int64).reshape(len(ids), -1)
                at = np.flatnonzero(ids % of_id == 0)
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(at), row["block"])), "anchor_id": pa.array(ids[at]), "label": pa.array(labels[at]), "vector": pa.array([exact[i].tobytes() for i in at], pa.binary())})

    return run


def _meetings(k: int, same: bool, low: int, high: int):
    """mapInArrow over rows sorted by (a, r, block), anchors first: rid, slot, score, vec_id."""

    def start(rows: list[dict]) -> Meeting:
        vectors = [np.frombuffer(r["vector"], np.int64) for r in rows]
        d = max(len(v) for v in vectors)
        scores = [r["scores"] or [] for r in rows]
        windows = 1 if same else max(1, max(len(s) for s in scores))
        lo, hi = np.full((len(rows), windows), NONE if same else ALL), np.full((len(rows), windows), ALL if same else NONE)
        for i, own in enumerate(scores):
            for w, s in enumerate(own):
                lo[i, w], hi[i, w] = -(-low * s // 100), high * s // 100
        column = lambda c: np.array([r[c] for r in rows], np.int64)
        return Meeting(column("anchor_id"), column("label"), np.stack([np.pad(v, (0, d - len(v))) for v in vectors]), lo, hi, k, same)

    def ended(meeting: Meeting | None, rows: list[dict]):
        if meeting is not None and len(meeting.key):
            rids = np.array([r["rid"] for r in rows], np.int64)
            yield pa.RecordBatch.from_pydict({"rid": pa.array(rids[meeting.key // meeting.windows]), "slot": pa.array((meeting.key % meeting.windows + 1).astype(np.int32)), "score": pa.array(meeting.score), "vec_id": pa.array(meeting.row)})

    def run(batches):
        cell, meeting, rows = None, None, []
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                here = (one.column("a")[0].as_py(), one.column("r")[0].as_py())
                if here != cell:
                    yield from ended(meeting, rows)
                    cell, meeting, rows = here, None, []
                row = one.to_pylist()[0]
                if row["block"] < 0:
                    rows.append(row)
                elif rows:
                    meeting = meeting or start(rows)
                    meeting.meet(_read(row))
        yield from ended(meeting, rows)

    return run


def _grid(file: DataFrame, anchors: DataFrame, k: int, same: bool, low: int = 0, high: int = 0) -> DataFrame:
    """(rid, slot, score, vec_id): the k best rows of each group of blocks for each anchor's windows; anchors: rid, block,
    anchor_id, label, vector, scores."""
    last = int(file.agg(F.max("block")).first()[0] or 0)
    row_blocks = max(1, min(ROW_BLOCKS, last // 16))
    groups = F.floor(F.col("block") / ANCHOR_BLOCKS), F.floor(F.col("block") / row_blocks)
    cells = (last // ANCHOR_BLOCKS + 1) * (last // row_blocks + 1)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    void = lambda c, kind: F.lit(None).cast(kind).alias(c)
    asked = anchors.select(groups[0].alias("a"), every(last // row_blocks).alias("r"), F.lit(-1).cast("long").alias("block"), "rid", "anchor_id", "label", "vector", "scores", *[void(c, "binary") for c in ("ids", "labels", "exact", "codes", "lows", "highs")])
    told = file.select(every(last // ANCHOR_BLOCKS).alias("a"), groups[1].alias("r"), "block", *[void(c, "long") for c in ("rid", "anchor_id", "label")], void("vector", "binary"), void("scores", "array<bigint>"), "ids", "labels", "exact", "codes", "lows", "highs")
    met = asked.union(told).repartition(min(2 * cells, MOST_TASKS), "a", "r").sortWithinPartitions("a", "r", "block")
    return met.mapInArrow(released(_meetings(k, same, low, high)), "rid long, slot int, score long, vec_id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor's window, with their rank."""
    by = Window.partitionBy("rid", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and vector (array of long) of the rows that take part."""
    fits = reduce(Column.__and__, [F.col(c).isNotNull() for c in ("vec_id", "label", "vector")])
    limit = F.array_max(F.transform("vector", lambda x: F.when(x.isNull() | (x == NONE), ALL).otherwise(F.abs(x))))
    dims = F.size("vector")
    most = reduce(lambda c, k: c.when(dims <= 1 << k, isqrt(ALL >> k)), range(1, 24), F.when(dims <= 1, isqrt(ALL))).otherwise(isqrt(ALL >> 31))
    return rows.filter(fits).filter(F.coalesce(limit, F.lit(0)) <= most).select(*[F.col(c).cast("long").alias(c) for c in ("vec_id", "label")], "vector")


def hard_negatives(rows: DataFrame, *, anchors: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a row whose vec_id is
    divisible by `anchors`) and each of its first `positives` other rows of its label, the first `negatives` rows of other
    labels whose score is from low to high percent of the positive's. Scores are integer inner products; higher come first,
    ties by smaller vec_id.

    rows needs vec_id, label and vector (array of long); other columns are ignored, so their names can't clash. Rows with a
    null in any of the three or in the vector take no part, nor do those with a component so large that inner products with
    their like could leave the range of long (over 2**28 at 65 to 128 dimensions). A shorter vector counts as one with zeros at its end. Repeated rows each count: as anchors each is answered,
    as positives and negatives each takes a place; a row of the anchor's own vec_id is not its positive. An empty table
    gives an empty result.
    """
    bound_batches(rows.sparkSession)
    file = materialize(usable(rows).mapInArrow(released(_file), FILE), "va-file")
    # Blocks are numbered without gaps; there is one row for each task that wrote any.
    parts = file.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    blocks = file.join(F.broadcast(parts), "part").withColumn("block", F.col("first") + F.col("number")).drop("part", "number", "first")
    asked = blocks.mapInArrow(released(_anchors(anchors)), "block long, anchor_id long, label long, vector binary")
    asked = materialize(asked.withColumn("rid", F.monotonically_increasing_id()), "va-anchors")
    found = _grid(blocks, asked.withColumn("scores", F.lit(None).cast("array<bigint>")), positives, True)
    best = materialize(_ranked(found, positives).select("rid", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "va-positives")
    # scores in order of slot: window w of an anchor is its positive of slot w + 1
    windows = best.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    found = materialize(_ranked(_grid(blocks, asked.join(windows, "rid"), negatives, False, low, high), negatives), "va-negatives")
    out = found.join(best, ["rid", "slot"]).join(asked.select("rid", "anchor_id"), "rid")
    forget(file)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_negatives(embeddings: DataFrame) -> DataFrame:
    """hard_negatives of embeddings (vec_id, embedding, label): where vec_id is divisible by 7 a label is taken one further,
    modulo 10, and components are floor(256 x). Rows with a component that is not finite take no part; else as there."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.filter(finite).select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))
    return hard_negatives(rows)
