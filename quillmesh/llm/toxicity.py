"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A step's input is a word: its hashed word embedding beside the maximum of its hashed character trigrams' embeddings
(with word edges). A block's distinct words are projected to the gates once, so a step costs one gather and two small
products. Windows of 32 words, 24 apart, cover every word of a text; a text's score is that of its worst window. Trained
in numpy, with gradients by hand: the first component of an embedding starts at a naive Bayes count of what the word or
trigram tells over a bounded sample (labelled.PER_CLASS), and the network learns on each text's most telling window,
then once more on the windows it rates worst itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, as_bytes, blocks, bound_batches, give_back, mix, released
from .labelled import held_out, prior_shift, training_rows

WIDTH, STRIDE, HIDDEN, EMBEDDED = 32, 24, 8, 6
WORD_BUCKETS, GRAM_BUCKETS = 1 << 18, 1 << 14
MODULUS, REST, THRESHOLD = 4, 2, 0.3
GATES, CHUNK, WORDS_AT_ONCE = 3 * HIDDEN, 1024, 1 << 16
#: Pseudo-texts behind a word's odds; texts that must have it to have odds.
SMOOTH, LEAST_TEXTS = 4.0, 3


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Inputs:
    """Word buckets, and each distinct word's trigram buckets, of a block of texts."""

    def __init__(self):
        self.words = Words(strip=b".,;:!?\"'()[]{}*#$%&|~^_=+<>/\\")
        self.fold = np.arange(256, dtype=np.uint64)
        self.fold[65:91] = self.fold[97:123]

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """at: word positions of each text; step: the distinct word of each position; bucket of each distinct word; ptr, grams: its trigrams."""
        parts = []
        for lo, hi in blocks(offsets):  # a block's arrays are several times its size: only its distinct words and their places are kept
            s, e, h, w = self.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            own, first, back = np.unique(h, return_index=True, return_inverse=True)
            parts.append((np.diff(w), own, s[first] + offsets[lo], (e - s)[first], back.astype(np.int32)))
        counts, known, starts, sizes, places = zip(*parts, strict=True) if parts else ((np.zeros(0, np.int64),),) * 5
        at = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int64)
        if not at[-1]:
            return at, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        h, first, back = np.unique(np.concatenate(known), return_index=True, return_inverse=True)
        s, n = np.concatenate(starts)[first], np.concatenate(sizes)[first]
        step, a, b = np.empty(at[-1], np.int32), 0, 0
        for own, place in zip(known, places, strict=True):
            step[a : a + len(place)] = back[b : b + len(own)][place]
            a, b = a + len(place), b + len(own)
        ptr = np.concatenate(([0], np.cumsum(n)))
        grams = np.empty(ptr[-1], np.int32)
        for a in range(0, len(n), WORDS_AT_ONCE):
            own = ptr[a : a + WORDS_AT_ONCE + 1]
            grams[own[0] : own[-1]] = self.trigrams(data, s[a : a + WORDS_AT_ONCE], own - own[0])
        return at, step, (h >> U64(40)).astype(np.int64) % WORD_BUCKETS, ptr, grams

    def trigrams(self, data: np.ndarray, starts: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Trigram buckets of the words that begin at `starts`; ptr: where each word's own begin."""
        b = self.fold[data[np.arange(ptr[-1]) - np.repeat(ptr[:-1] - starts, np.diff(ptr))]]
        left = np.concatenate((b[:1], b[:-1]))
        left[ptr[:-1]] = 1
        right = np.concatenate((b[1:], b[:1]))
        right[ptr[1:] - 1] = 2
        return (mix(left << U64(16) | b << U64(8) | right) >> U64(40)).astype(np.int64) % GRAM_BUCKETS


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of the overlapping windows over every text with words; together they cover each word."""
    n = np.diff(at)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WIDTH) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * STRIDE, np.maximum(0, n[text] - WIDTH))
    return text, at[:-1][text] + start, np.minimum(WIDTH, n[text] - start)


class GatedNetwork:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        small = lambda *s, by=0.3: r.normal(0, by, s).astype(np.float32)
        self.p = {"word": np.zeros((WORD_BUCKETS, EMBEDDED), np.float32), "gram": small(GRAM_BUCKETS, EMBEDDED, by=0.02), "in": small(2 * EMBEDDED, 2 * GATES)}
        for d in "fb":
            self.p |= {f"u{d}": small(HIDDEN, 2 * HIDDEN), f"c{d}": small(HIDDEN, HIDDEN), f"g{d}": np.zeros(GATES, np.float32)}
        self.p |= {"att": small(2 * HIDDEN), "out": small(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.shift = 0.0

    def embedded(self, bucket: np.ndarray, ptr: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Each distinct word's input: its own embedding, and its trigrams' largest components."""
        out = np.empty((len(bucket), 2 * EMBEDDED), np.float32)
        out[:, :EMBEDDED] = self.p["word"][bucket]
        for a in range(0, len(bucket), WORDS_AT_ONCE):
            own = ptr[a : a + WORDS_AT_ONCE + 1]
            out[a : a + WORDS_AT_ONCE, EMBEDDED:] = np.maximum.reduceat(self.p["gram"][grams[own[0] : own[-1]]], own[:-1] - own[0], axis=0)
        return out

    def projected(self, bucket: np.ndarray, ptr: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs of each distinct word."""
        return self.embedded(bucket, ptr, grams) @ self.p["in"]

    def direction(self, d: str, proj: np.ndarray, steps: np.ndarray, live: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States (steps, windows, HIDDEN) of one direction; proj: gate inputs by distinct word; where live is 0 the state stays."""
        u, c = self.p[f"u{d}"], self.p[f"c{d}"]
        proj = proj + self.p[f"g{d}"]
        h = np.zeros((steps.shape[1], HIDDEN), np.float32)
        out = np.empty((*steps.shape, HIDDEN), np.float32)
        full = live.all(axis=1)
        for t in range(len(steps)) if d == "f" else range(len(steps) - 1, -1, -1):
            xt = proj[steps[t]]
            zr = h @ u
            zr += xt[:, : 2 * HIDDEN]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            n = (zr[:, HIDDEN:] * h) @ c
            n += xt[:, 2 * HIDDEN :]
            np.tanh(n, out=n)
            if tape is not None:
                tape.append((t, h, zr, n))
            step = n - h
            step *= zr[:, :HIDDEN]
            if not full[t]:
                step *= live[t][:, None]
            h = np.add(h, step, out=out[t])
        return out

    def forward(self, proj: np.ndarray, steps: np.ndarray, live: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows; steps (WIDTH, windows): distinct words."""
        states = []
        for k, d in enumerate("fb"):
            if tape is not None:
                tape[d] = []
            states.append(self.direction(d, np.ascontiguousarray(proj[:, k * GATES : (k + 1) * GATES]), steps, live, None if tape is None else tape[d]))
        s = np.concatenate(states, axis=2)
        a = s @ self.p["att"]
        a = np.exp(a - a.max(axis=0)) * live
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, s)
        if tape is not None:
            tape |= {"s": s, "a": a, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, steps: np.ndarray, live: np.ndarray, tape: dict, err: np.ndarray, n_words: int) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of each distinct word's gate inputs."""
        s, a, pooled = tape["s"], tape["a"], tape["pooled"]
        g = {"out": pooled.T @ err, "bias": np.array([err.sum()], np.float32)}
        dpool = err[:, None] * self.p["out"]
        da = np.einsum("tbh,bh->tb", s, dpool)
        dscore = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("tb,tbh->h", dscore, s)
        ds = a[:, :, None] * dpool + dscore[:, :, None] * self.p["att"]
        dproj = np.zeros((n_words, 2 * GATES), np.float32)
        for k, d in enumerate("fb"):
            u, c = self.p[f"u{d}"], self.p[f"c{d}"]
            du, dc, dg, dh = np.zeros_like(u), np.zeros_like(c), np.zeros(GATES, np.float32), np.zeros((steps.shape[1], HIDDEN), np.float32)
            for t, h, zr, n in reversed(tape[d]):
                dh = dh + ds[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                on = live[t][:, None]
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                dn = dh * z * on * (1 - n * n)
                dz = dh * (n - h) * on * z * (1 - z)
                drh = dn @ c.T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate((dz, dr), axis=1)
                dc += (r * h).T @ dn
                du += h.T @ dzr
                dx = np.concatenate((dzr, dn), axis=1)
                dg += dx.sum(axis=0)
                np.add.at(dproj[:, k * GATES : (k + 1) * GATES], steps[t], dx)
                dh = dh * (1 - z * on) + drh * r + dzr @ u.T
            g |= {f"u{d}": du, f"c{d}": dc, f"g{d}": dg}
        return g, dproj

    def text_scores(self, data: np.ndarray, offsets: np.ndarray, inputs: Inputs) -> tuple[np.ndarray, np.ndarray]:
        """The worst window's logit of each text (-inf without words), and that window's first word position."""
        at, step, bucket, ptr, grams = inputs(data, offsets)
        text, start, length = windows(at)
        worst, where = np.full(len(at) - 1, -np.inf), np.zeros(len(at) - 1, np.int64)
        proj = self.projected(bucket, ptr, grams)
        for k in range(0, len(text), CHUNK):
            steps, live = laid_out(step, start[k : k + CHUNK], length[k : k + CHUNK])
            z = self.forward(proj, steps, live) + self.shift
            order = np.argsort(z, kind="stable")
            t = text[k : k + CHUNK][order]
            better = z[order] > worst[t]
            worst[t[better]] = z[order][better]  # ascending, so the largest stays
            where[t[better]] = start[k : k + CHUNK][order][better]
        return worst, where - at[:-1]

    def scores(self, data: np.ndarray, offsets: np.ndarray, inputs: Inputs) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in blocks(offsets):
            z, _ = self.text_scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], inputs)
            out.append(sigmoid(np.clip(z, -30, 30)) * np.isfinite(z))
        return np.concatenate(out)

    def fit(self, texts: list[str], ys: list[int], share: float, epochs: int = 3, rounds: int = 2, seed: int = 13) -> GatedNetwork:
        if not texts or len(set(ys)) < 2:
            self.p["bias"][0] = -30.0 if not sum(ys) else 0.0
            return self
        raw = [t.encode() for t in texts]
        offs = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
        data, y = np.frombuffer(b"".join(raw), np.uint8), np.array(ys, np.float32)
        del raw
        at, step, bucket, ptr, grams = Inputs()(data, offs)
        text, start, length = windows(at)
        r = np.random.default_rng(seed)
        told, by_word, by_gram = telling(at, step, bucket, ptr, grams, y)
        self.p["word"][:, 0], self.p["gram"][:, 0] = by_word, by_gram
        level = np.array([told[step[s : s + n]].max() for s, n in zip(start, length, strict=True)])
        squares = {k: np.full_like(v, 1e-4) for k, v in self.p.items()}
        for turn in range(rounds):
            if turn:
                proj = self.projected(bucket, ptr, grams)
                level = np.concatenate([self.forward(proj, *laid_out(step, start[k : k + CHUNK], length[k : k + CHUNK])) for k in range(0, len(text), CHUNK)])
            order = np.lexsort((level, text))
            last = order[np.append(text[order][1:] != text[order][:-1], True)]  # each text's most telling window
            other = r.permutation(np.flatnonzero(y[text] == 0))[: len(last)]  # any windows of clean texts
            chosen = np.concatenate((last, last[y[text[last]] == 1], other))
            for _ in range(epochs):
                chosen = r.permutation(chosen)
                for k in range(0, len(chosen), 128):
                    pick = chosen[k : k + 128]
                    steps, live = laid_out(step, start[pick], length[pick])
                    used, back = np.unique(steps, return_inverse=True)
                    self.learn(used, back.reshape(steps.shape), live, y[text[pick]], bucket, ptr, grams, squares)
        self.shift = 0.0
        inputs = Inputs()
        whole = np.concatenate([self.text_scores(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], inputs)[0] for a, b in blocks(offs)])
        self.shift = prior_shift(ys, share) + best_shift(whole, y)
        return self

    def learn(self, used, steps, live, y, bucket, ptr, grams, squares, rate: float = 0.05) -> None:
        n = np.diff(ptr)[used]
        own = np.concatenate(([0], np.cumsum(n)))
        where = grams[np.arange(own[-1]) - np.repeat(own[:-1] - ptr[used], n)]
        tape: dict = {}
        x = self.embedded(bucket[used], own, where)
        z = self.forward(x @ self.p["in"], steps, live, tape)
        err = ((sigmoid(np.clip(z, -30, 30)) - y) / len(y)).astype(np.float32)
        g, dproj = self.gradients(steps, live, tape, err, len(used))
        g["in"] = x.T @ dproj
        dx = dproj @ self.p["in"].T
        for k, d in g.items():
            squares[k] += d * d
            self.p[k] = (self.p[k] - rate * d / np.sqrt(squares[k])).astype(np.float32)
        largest = self.p["gram"][where] == np.repeat(x[:, EMBEDDED:], n, axis=0)
        for k, rows, d in (("word", bucket[used], dx[:, :EMBEDDED]), ("gram", where, np.repeat(dx[:, EMBEDDED:], n, axis=0) * largest)):
            order = np.argsort(rows, kind="stable")
            hit, first = np.unique(rows[order], return_index=True)
            total = np.add.reduceat(d[order], first, axis=0)
            squares[k][hit] += total * total
            self.p[k][hit] -= rate * total / np.sqrt(squares[k][hit])


def laid_out(step: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WIDTH, windows) distinct words and whether a step is within its window."""
    k = np.arange(WIDTH)[:, None]
    live = (k < length).astype(np.float32)
    return step[start + np.minimum(k, length - 1)], live


def telling(at, step, bucket, ptr, grams, y) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How much presence in a text speaks for label 1, as smoothed log odds: of each distinct word (its own, or its best trigram's), of all word buckets, of all trigram buckets."""
    def odds(present, size):
        """Log odds of each key from (text, key) pairs, given a block of texts at a time to bound memory."""
        ones, both = np.zeros(size), np.zeros(size)
        for rows, keys in present:
            pairs = np.unique(rows * size + keys)
            ones += np.bincount(pairs % size, y[pairs // size], size)
            both += np.bincount(pairs % size, minlength=size)
        share = y.sum() / len(y)
        return (both >= LEAST_TEXTS) * (np.log((ones + SMOOTH * share) / (both - ones + SMOOTH * (1 - share))) - np.log(share / (1 - share)))

    def words_of_texts(texts: int = 100):
        for a in range(0, len(y), texts):
            ends = at[a : a + texts + 1]
            yield np.repeat(np.arange(a, a + len(ends) - 1), np.diff(ends)), step[ends[0] : ends[-1]]

    def grams_of_texts():
        n = np.diff(ptr)
        for rows, words in words_of_texts():
            seen = np.unique(rows * len(bucket) + words)
            word = seen % len(bucket)
            own = np.concatenate(([0], np.cumsum(n[word])))
            yield np.repeat(seen // len(bucket), n[word]), grams[np.arange(own[-1]) - np.repeat(own[:-1] - ptr[word], n[word])]

    by_word = odds(((rows, bucket[words]) for rows, words in words_of_texts()), WORD_BUCKETS)
    by_gram = odds(grams_of_texts(), GRAM_BUCKETS)
    return np.maximum(by_word[bucket], np.maximum.reduceat(by_gram[grams], ptr[:-1])), by_word, by_gram


def best_shift(z: np.ndarray, y: np.ndarray) -> float:
    """Puts the logit that separates the training texts best, between the scores around it, at the decision's middle."""
    order = np.argsort(z, kind="stable")
    right = np.cumsum(1 - y[order]) + y.sum() - np.cumsum(y[order])
    k = int(np.argmax(right))
    if k + 1 >= len(z) or not np.isfinite(z[order[k]]):
        return 0.0
    return -float(z[order[k]] + z[order[k + 1]]) / 2


def train(docs: DataFrame, labels: DataFrame) -> GatedNetwork:
    """The model of labels.toxic; without labels of both kinds it scores every text alike."""
    model = GatedNetwork().fit(*training_rows(docs, labels, "toxic", MODULUS, REST))
    give_back()  # the driver's texts and features
    return model


def toxicity_scores(docs: DataFrame, model: GatedNetwork, out: str = "score") -> DataFrame:
    """docs with the score (0 to 1) of each whole text; texts without words, empty or null score 0. It is in column `out`; a column of that name is replaced.

    The model is of fixed size ((WORD_BUCKETS + GRAM_BUCKETS) * 2 * GATES floats), so it travels with the tasks.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop(out)
    names = docs.columns

    def run(batches):
        inputs = Inputs()
        for b in batches:
            data, offs = as_bytes(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(data, offs, inputs), pa.float64())], names=[*names, out])

    return docs.mapInArrow(released(run), docs.withColumn(out, F.lit(0.0)).schema)


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every row, repeated rows included."""
    scored = toxicity_scores(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
