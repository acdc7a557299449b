"""What the training-data operators share: written intermediate tables, bounded Arrow batches and word hashing in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..session import BATCH_BYTES, BATCH_ROWS, bound_batches, forget, materialize, no_broadcasts  # noqa: F401

U64 = np.uint64


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def released(run):
    """A function over batches that gives what memory it has freed back to the system when it ends: Python workers are used
    again by other stages, and their peaks would add up."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def as_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and its n + 1 offsets, without a copy; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes, each of one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise modulo 2**64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Word spans and 64-bit word hashes of a block of texts, by prefix sums over bytes; no loop over words.

    Words are runs of bytes other than space and \\t to \\r; A to Z count as lower case when `fold` is set.
    """

    SEP = np.zeros(256, bool)
    SEP[[0x20, *range(0x09, 0x0E)]] = True

    def __init__(self, fold: bool = True, strip: bytes = b""):
        r = np.random.default_rng(20240229)
        self.value = r.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        if fold:
            self.value[65:91] = self.value[97:123]
        self.sep = self.SEP.copy()
        self.sep[list(strip)] = True
        self.value[self.sep] = 0
        self.base = int(r.integers(2**62, 2**63)) | 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of all words, and the n + 1 positions at which each text's words begin."""
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64)
        self._powers(n)
        gap = self.sep[data]
        before = np.empty(n, bool)
        before[0], before[1:] = True, gap[:-1]
        edges = offsets[1:-1]
        before[edges[edges < n]] = True
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, gap[1:]
        after[edges[(edges > 0)] - 1] = True
        starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
        if len(starts):
            sums = np.add.reduceat(self.value[data] * self.up[:n], starts)
            hashes = mix(sums * self.down[starts] + U64(0x9E3779B97F4A7C15))
        else:
            hashes = np.zeros(0, np.uint64)
        return starts, ends, hashes, np.searchsorted(starts, offsets)
