"""Hierarchical multi-length packing of documents into training sequences.

A document's whole 2048-token windows are sequences at once. Its rest is routed to the smallest tier of context sizes
(256, 512, 1024, 2048) that holds it. Each tier's rests open windows of its size, longest tier first; the gap of a
window is filled from shorter tiers, largest piece first, at last by a piece cut to fit. So every window but a task's
last is exactly full, at a power of two, and needs no padding. Windows are dealt into step groups of equal tokens:
GROUP_TOKENS of one tier make a step.

Packing is done within each task over the rows it scans: no shuffle, no document leaves its task, memory is bounded by
FLUSH_TOKENS of rests. Sequence ids are the task's number above 2**33 plus a count, so a task that is run again gives
the same ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bound_batches, released
from .wordids import cached_ids

TIERS, WINDOW = (256, 512, 1024, 2048), 2048
FLUSH_TOKENS, GROUP_TOKENS, END_ID = 1 << 18, 1 << 14, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Piece:
    """A span of a document's ids that waits for a window."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, ids: np.ndarray, start: int, total: int):
        self.doc, self.ids, self.start, self.total = doc, ids, start, total

    def cut(self, n: int) -> Piece:
        """Takes the first n ids off."""
        head = Piece(self.doc, self.ids[:n], self.start, self.total)
        self.ids, self.start = self.ids[n:], self.start + n
        return head

    def __lt__(self, other: Piece) -> bool:
        return len(self.ids) < len(other.ids)


class Packer:
    def __init__(self, task: int):
        self.first, self.sequences = task << 33, 0
        self.tiers: dict[int, list[Piece]] = {t: [] for t in TIERS}
        self.waiting = 0
        self.filled = dict.fromkeys(TIERS, 0)
        self.rows: list[tuple] = []

    def emit(self, pieces: list[Piece], tier: int) -> None:
        sequence, offset = self.first + self.sequences, 0
        self.sequences += 1
        group = (self.first >> 33 << 33) + (TIERS.index(tier) << 30) + self.filled[tier] // GROUP_TOKENS
        self.filled[tier] += tier
        for p in pieces:
            self.rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, sequence, offset, tier, group))
            offset += len(p.ids)

    def route(self, piece: Piece) -> None:
        self.waiting += len(piece.ids)
        insort(self.tiers[next(t for t in TIERS if len(piece.ids) <= t)], piece)

    def add(self, doc, ids: np.ndarray) -> None:
        whole = Piece(doc, ids, 0, len(ids))
        while len(whole.ids) >= WINDOW:
            self.emit([whole.cut(WINDOW)], WINDOW)
        if len(whole.ids):
            self.route(whole)
        if self.waiting >= FLUSH_TOKENS:
            self.pack()

    def take(self, gap: int) -> Piece | None:
        """The largest waiting piece that fits the gap, or else the head of the shortest that doesn't."""
        best = None
        for t in TIERS:
            queue = self.tiers[t]
            k = bisect_right(queue, gap, key=lambda p: len(p.ids))
            if k:
                best = queue, k - 1
            if k < len(queue):
                if best is None:
                    cut = queue.pop(k)
                    self.waiting -= len(cut.ids)
                    head = cut.cut(gap)
                    self.route(cut)
                    return head
                break
        if best is None:
            return None
        piece = best[0].pop(best[1])
        self.waiting -= len(piece.ids)
        return piece

    def pack(self, last: bool = False) -> None:
        """Opens windows by tier, longest first, while enough waits to fill them; at last what is left, too."""
        for tier in reversed(TIERS):
            while self.tiers[tier] and self.waiting >= tier:
                piece = self.tiers[tier].pop()
                self.waiting -= len(piece.ids)
                window, gap = [piece], tier - len(piece.ids)
                while gap:
                    more = self.take(gap)
                    window.append(more)
                    gap -= len(more.ids)
                self.emit(window, tier)
        if last and self.waiting:
            rest = [p for t in reversed(TIERS) for p in self.tiers[t]]
            self.tiers, self.waiting = {t: [] for t in TIERS}, 0
            self.emit(rest, WINDOW)

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [()] * 9
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split(" ")[0] for f in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece, in sequences of at most 2048 tokens; see SCHEMA.

    Each document's ids end in END_ID, so an empty or null text is one piece of one token. A null doc_id is carried as
    null. Repeated rows are packed each. Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        encode, packer, end = cached_ids(tokenizer_path), Packer(TaskContext.get().partitionId()), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for k in range(0, len(texts), 200):
                for doc, raw in zip(ids[k : k + 200], encode([t or "" for t in texts[k : k + 200]]), strict=True):
                    packer.add(doc, np.frombuffer(raw + end, "<u4"))
            yield packer.drain()
        packer.pack(last=True)
        yield packer.drain()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(released(run), SCHEMA)
