"""Byte-level BPE: ranked merges over distinct words, in Spark higher-order functions and, for rare words, in numpy.

encode_words() folds the merges of each distinct word natively: a word is an array of its bytes in hex, each step of the
fold joins the pair of lowest rank, and ranks come from a literal map, split into buckets by hash since a lookup in one
map of 50,000 entries would scan it. decode_ids() looks up a literal array of pieces and concatenates them.

encode_documents() handles whole texts. The frequent words' ids are folded natively once, into a table of at most
FREQUENT words; that bound makes it small enough to travel with the tasks. A task encodes the other distinct words it
meets with the same ranked merges, done for many words at once over arrays, and caches them. Sending each rare word's
ids back to its texts by a join instead would shuffle a row for every such word of every text: several times the input.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, released

FREQUENT, SAMPLED_DOCS, CACHED, LONGEST = 8_000, 1000, 300_000, 40
RANK_BUCKETS = 8192
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def _bucket(piece: str) -> int:
    """A piece's bucket, as _lookup computes it in SQL."""
    import zlib

    return zlib.crc32(piece.encode()) % RANK_BUCKETS


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<string, int>>: ranks by hex piece, in hash buckets; the optimizer folds it into one literal."""
    parts: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for piece, rank in ranks.items():
        parts[_bucket(piece.hex().upper())][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(parts)), "array<map<string,int>>")


def _lookup(table: Column, piece: Column) -> Column:
    return F.try_element_at(F.get(table, F.pmod(F.crc32(piece.cast("binary")), F.lit(RANK_BUCKETS)).cast("int")), piece)


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """words with ids array<int>: a fold over as many steps as a word has pairs; each merges the leftmost pair of lowest rank."""
    table = rank_literal(ranks)
    pieces = F.regexp_extract_all(F.hex(F.encode(F.col(word), "utf-8")), F.lit("(..)"), F.lit(1))

    def step(now: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(now) - 1), lambda i: F.struct(_lookup(table, F.concat(F.element_at(now, i), F.element_at(now, i + 1))).alias("rank"), i.alias("i")))
        best = F.array_min(F.filter(pairs, lambda p: p["rank"].isNotNull()))["i"]
        joined = F.concat(F.slice(now, F.lit(1), best - 1), F.array(F.concat(F.element_at(now, best), F.element_at(now, best + 1))), F.slice(now, best + 2, F.size(now)))
        return F.when(F.size(now) < 2, now).otherwise(F.coalesce(joined, now))

    steps = F.when(F.size(pieces) > 1, F.sequence(F.lit(2), F.size(pieces))).otherwise(F.array().cast("array<int>"))
    return words.withColumn("pieces", pieces).withColumn("pieces", F.aggregate(steps, F.col("pieces"), step)).withColumn("ids", F.transform("pieces", lambda p: _lookup(table, p))).drop("pieces")


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: binary pieces looked up in a literal array and concatenated."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), ""))


class RankedMerges:
    """The same merges over many distinct words at once: a matrix of ids, and of the ranks of neighbours."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = rank
        self.size = 1 << 20
        self.keys, self.values = np.full(self.size, 2**32 - 1, np.uint32), np.full(self.size, self.NONE, np.int32)
        keys, values = np.fromiter(pairs.keys(), np.uint32), np.fromiter(pairs.values(), np.int32)
        slot, self.probes = self.slot(keys), 0
        while len(keys):  # linear probing, all keys at a time
            free = self.keys[slot] == 2**32 - 1
            put, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[put >= 0]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) % self.size
            self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        slot = self.slot(key)
        out = np.where(self.keys[slot] == key, self.values[slot], self.NONE)
        todo = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != 2**32 - 1))
        at = slot[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (at + 1) % self.size
            found = self.keys[at] == key[todo]
            out[todo[found]] = self.values[at[found]]
            on = ~found & (self.keys[at] != 2**32 - 1)
            todo, at = todo[on], at[on]
        return out

    def one(self, word: bytes) -> list[int]:
        """A long word, pair by pair."""
        ids = self.single[np.frombuffer(word, np.uint8)]
        while len(ids) > 1:
            rank = self.rank(ids[:-1], ids[1:])
            low = rank.min()
            if low == self.NONE:
                break
            hit = np.flatnonzero(rank == low)
            take, last = [], -2
            for h in hit.tolist():  # leftmost first; neighbours that overlap wait
                if h > last + 1:
                    take.append(h)
                    last = h
            ids[take] = low
            ids = np.delete(ids, np.array(take) + 1)
        return ids.tolist()

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        for k in np.flatnonzero(sizes > LONGEST).tolist():
            out[k] = np.array(self.one(words[k]), "<u4").tobytes()
        order = np.flatnonzero(sizes <= LONGEST)
        order = order[np.argsort(sizes[order], kind="stable")]
        for a in range(0, len(order), 4096):
            some = order[a : a + 4096]
            n = sizes[some]
            wide = int(n[-1]) + 1
            flat = self.single[np.frombuffer(b"".join(words[k] for k in some.tolist()), np.uint8)]
            ids = np.zeros((len(some), wide), np.int32)
            inside = np.arange(wide) < n[:, None]
            ids[inside] = flat
            rank = np.full((len(some), wide), self.NONE, np.int32)
            pair = np.arange(wide - 1) < n[:, None] - 1
            left, right = ids[:, :-1][pair], ids[:, 1:][pair]
            rank[:, :-1][pair] = self.rank(left, right)
            live = np.arange(len(some))
            while len(live):
                at = rank[live].argmin(axis=1)
                low = rank[live, at]
                on = low != self.NONE
                live, at, low = live[on], at[on], low[on]
                if not len(live):
                    break
                n[live] -= 1
                moved = np.arange(wide)[None, :]
                moved = np.minimum(moved + (moved > at[:, None]), wide - 1)
                ids[live] = np.take_along_axis(ids[live], moved, axis=1)
                # The pair at `at` and those after it move left; the two that touch the new id are ranked anew.
                shifted = np.take_along_axis(rank[live], moved, axis=1)
                shifted[:, -1] = self.NONE
                ids[live, at] = low
                rank[live] = shifted
                rank[live, at] = np.where(at + 1 < n[live], self.rank(low, ids[live, np.minimum(at + 1, wide - 1)]), self.NONE)
                before = at > 0
                rank[live[before], at[before] - 1] = self.rank(ids[live[before], at[before] - 1], low[before])
            for k, row, m in zip(some.tolist(), ids.astype("<u4"), n.tolist(), strict=True):
                out[k] = row[:m].tobytes()
        return out


class TextEncoder:
    """Ids of whole texts; each match of the pattern separately. The cache is emptied at CACHED entries."""

    #: White space other than blank, tab and line ends: texts with it are split by the pattern itself.
    ODD = regex.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    RUN = regex.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")

    def __init__(self, ranks: dict[bytes, int], pattern: str, frequent: dict[str, bytes]):
        self.merges, self.pattern = RankedMerges(ranks), regex.compile(pattern)
        self.frequent, self.runs, self.words = frequent, {}, dict(frequent)

    def cut(self, text: str) -> list[str]:
        """Runs of white space with what follows: no match of the pattern spans two, so each is encoded by itself."""
        return self.pattern.findall(text) if self.ODD.search(text) else self.RUN.findall(text)

    def learn(self, runs: Iterable[str]) -> None:
        split = {r: self.pattern.findall(r) for r in runs}
        new = list({w for ws in split.values() for w in ws if w not in self.words})
        self.words.update(zip(new, self.merges([w.encode() for w in new]), strict=True))
        for r, ws in split.items():
            self.runs[r] = self.words[ws[0]] if len(ws) == 1 else b"".join([self.words[w] for w in ws])

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [self.cut(t) for t in texts]
        new = set().union(*parts) - self.runs.keys()
        if new:
            if len(self.runs) + len(new) > CACHED or len(self.words) > CACHED + FREQUENT:
                self.runs, self.words = {}, dict(self.frequent)
                new = set().union(*parts)
            self.learn(new)
        get = self.runs.__getitem__
        return [b"".join(map(get, p)) for p in parts]


_KEPT: dict[bytes, TextEncoder] = {}


def vocabulary_key(ranks: dict[bytes, int], pattern: str, frequent: dict[str, bytes]) -> bytes:
    """What tells vocabularies, patterns and ready words apart, whatever their sizes."""
    h = hashlib.sha256(pattern.encode())
    for piece, rank in sorted(ranks.items()):
        h.update(b"%d:%d:%b" % (rank, len(piece), piece))
    for word, ids in sorted(frequent.items()):
        h.update(b"%d:%b%d:%b" % (len(word.encode()), word.encode(), len(ids), ids))
    return h.digest()


def text_encoder(key: bytes, ranks: dict[bytes, int], pattern: str, frequent: dict[str, bytes]) -> TextEncoder:
    """This process's encoder of a vocabulary_key: a Python worker keeps it, and what it has cached, from task to task."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = TextEncoder(ranks, pattern, frequent)
    return _KEPT[key]


def frequent_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = FREQUENT, sampled: int = SAMPLED_DOCS) -> dict[str, bytes]:
    """Ids of the most frequent words of a bounded sample of documents, folded natively.

    The sample decides only which words come ready to the tasks, never what their ids are.
    """
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(sampled).distinct()
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter(F.octet_length("text") < 1 << 16)
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit("(?U)(" + pattern + ")"), F.lit(1))).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "word").limit(most).select("word")
    return {r["word"]: np.array(r["ids"], "<u4").tobytes() for r in encode_words(top, ranks).collect()}


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """One row per document, see SCHEMA: its ids' digest, and that of the bytes they decode to.

    A null text is empty: no ids. Repeated rows are repeated, a null doc_id stays null, columns other than doc_id and text
    are not read, an empty table gives no rows. Nothing is shuffled: each text is read once by the task that encodes it.
    """
    bound_batches(docs.sparkSession)
    frequent = frequent_words(docs, ranks, pattern)
    key = vocabulary_key(ranks, pattern, frequent)

    def run(batches):
        encode = text_encoder(key, ranks, pattern, frequent)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        get = pieces.__getitem__
        for b in batches:
            texts, n, ids, decoded = b.column("text").to_pylist(), [], [], []
            for k in range(0, len(texts), 200):
                for raw in encode([t or "" for t in texts[k : k + 200]]):
                    n.append(len(raw) // 4)
                    ids.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(get, np.frombuffer(raw, "<u4").tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(released(run), SCHEMA)
