"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions of
words with words, words with statistics and statistics with one another, in time linear in the features. Words count by
their share of the text; statistics (length, letter case, symbols, repetition of words and lines ...) are one of 16 bins
each. Trained in numpy by AdaGrad on a bounded sample (labelled.PER_CLASS); scored over whole texts in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, blocks, bound_batches, give_back, released
from .labelled import held_out, prior_shift, training_rows

BUCKETS, BINS, RANK = 1 << 15, 16, 8
MODULUS, REST = 3, 1
EDGES = np.array([0.001, 0.003, 0.006, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.9])
#: Character classes whose share of a text is a statistic.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"*#$%&@^~_=+", b"|<>{}[]()/\\", b"\n", b" ", b"\"'-", bytes(range(128, 256)))
STATISTICS = len(CLASSES) + 5
SIZE = BUCKETS + STATISTICS * BINS


class Features:
    """Sparse rows (ptr, index, value) of a block of texts."""

    def __init__(self):
        self.words, self.lines = Words(), Words(fold=False)
        self.lines.sep = np.zeros(256, bool)
        self.lines.sep[[10, 13]] = True
        self.lines.value = Words(fold=False).value.copy()
        self.lines.value[self.lines.value == 0] = 0x9E3779B97F4A7C15
        self.lines.value[[10, 13]] = 0
        self.kind = np.full(256, len(CLASSES), np.uint8)
        for k, c in enumerate(CLASSES):
            self.kind[list(c)] = k

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        starts, ends, h, at = self.words(data, offsets)
        count = np.diff(at)
        row = np.repeat(np.arange(n), count)
        key, times = np.unique(row * BUCKETS + (h >> np.uint64(40)).astype(np.int64) % BUCKETS, return_counts=True)
        rows, index = key // BUCKETS, key % BUCKETS
        value = 3.0 * times / np.maximum(count, 1)[rows]
        owner = np.repeat(np.arange(n), np.diff(offsets))
        kinds = np.bincount(owner * (len(CLASSES) + 1) + self.kind[data], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)
        size = np.maximum(np.diff(offsets), 1)
        shares = np.empty((n, STATISTICS))
        shares[:, : len(CLASSES)] = kinds[:, : len(CLASSES)] / size[:, None]
        distinct = np.bincount(rows, minlength=n)
        _, _, lh, lat = self.lines(data, offsets)
        lrow = np.repeat(np.arange(n), np.diff(lat))
        pairs = np.unique(lrow.astype(np.uint64) << np.uint64(40) | lh >> np.uint64(24))
        kept = np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=n)
        nl = np.maximum(np.diff(lat), 1)
        shares[:, -5] = distinct / np.maximum(count, 1)
        shares[:, -4] = 1 - kept / nl
        shares[:, -3] = np.log2(1 + np.diff(offsets)) / 24
        shares[:, -2] = np.bincount(row, ends - starts, minlength=n) / np.maximum(count, 1) / 32
        shares[:, -1] = np.log2(1 + count / nl) / 16
        bins = np.searchsorted(EDGES, shares) + np.arange(STATISTICS) * BINS + BUCKETS
        rows = np.concatenate((rows, np.repeat(np.arange(n), STATISTICS)))
        order = np.argsort(rows, kind="stable")
        index = np.concatenate((index, bins.ravel()))[order]
        value = np.concatenate((value, np.full(n * STATISTICS, 0.3)))[order].astype(np.float32)
        return np.searchsorted(rows[order], np.arange(n + 1)), index, value


class FactorisationMachine:
    def __init__(self, rank: int = RANK, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(SIZE, np.float32)
        self.v = r.normal(0, 0.05, (SIZE, rank)).astype(np.float32)

    def logits(self, ptr: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits and the rows' factor sums; every row has a feature."""
        sums = np.add.reduceat(self.v[index] * value[:, None], ptr[:-1], axis=0)
        line = np.add.reduceat(self.w[index] * value, ptr[:-1])
        own = np.add.reduceat(np.einsum("ij,ij->i", self.v, self.v)[index] * value * value, ptr[:-1])
        return self.w0 + line + 0.5 * ((sums * sums).sum(axis=1) - own), sums

    def fit(self, texts: list[str], ys: list[int], share: float, epochs: int = 12, batch: int = 64, rate: float = 0.15, decay: float = 1e-5, seed: int = 9) -> FactorisationMachine:
        if not texts:
            return self
        raw = [t.encode() for t in texts]
        offs = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
        data, y = np.frombuffer(b"".join(raw), np.uint8), np.array(ys, np.float32)
        features, parts = Features(), []
        for a, b in blocks(offs):
            ptr, i, x = features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            parts += [(i[ptr[k] : ptr[k + 1]], x[ptr[k] : ptr[k + 1]]) for k in range(b - a)]
        r = np.random.default_rng(seed)
        gw, gv, g0 = np.full_like(self.w, 1e-4), np.full_like(self.v, 1e-4), 1e-4
        for _ in range(epochs):
            order = r.permutation(len(parts))
            for k in range(0, len(order), batch):
                pick = order[k : k + batch]
                index = np.concatenate([parts[p][0] for p in pick])
                value = np.concatenate([parts[p][1] for p in pick])
                ptr = np.concatenate(([0], np.cumsum([len(parts[p][0]) for p in pick])))
                z, sums = self.logits(ptr, index, value)
                err = (1 / (1 + np.exp(-z)) - y[pick]).astype(np.float32) / len(pick)
                row = np.repeat(np.arange(len(pick)), np.diff(ptr))
                e = err[row] * value
                used, back = np.unique(index, return_inverse=True)
                dw = np.bincount(back, e, len(used)).astype(np.float32) + decay * self.w[used]
                full = e[:, None] * (sums[row] - self.v[index] * value[:, None])
                dv = np.stack([np.bincount(back, full[:, f], len(used)) for f in range(full.shape[1])], axis=1).astype(np.float32) + decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                g0 += float(err.sum()) ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
                self.w0 -= rate * float(err.sum()) / g0**0.5
        self.w0 += prior_shift(ys, share)
        return self

    def scores(self, data: np.ndarray, offsets: np.ndarray, features: Features) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in blocks(offsets):
            z, _ = self.logits(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame) -> FactorisationMachine:
    """The model of labels.quality; without labelled rows it scores every text near 0.5."""
    model = FactorisationMachine().fit(*training_rows(docs, labels, "quality", MODULUS, REST))
    give_back()  # the driver's texts and features
    return model


def quality_scores(docs: DataFrame, model: FactorisationMachine, out: str = "score") -> DataFrame:
    """docs with the score (0 to 1) of each whole text; a null text counts as empty. in column `out`; a column of that name is replaced.

    The model is of fixed size (SIZE * (RANK + 1) floats), so it travels with the tasks.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop(out)
    names = docs.columns

    def run(batches):
        features = Features()
        for b in batches:
            data, offs = as_bytes(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(data, offs, features), pa.float64())], names=[*names, out])

    return docs.mapInArrow(released(run), docs.withColumn(out, F.lit(0.0)).schema)


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every row, repeated rows included."""
    scored = quality_scores(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
