"""Prefix polynomial hashes of texts: equality of any spans, longest common extensions, and short fingerprints.

prefix[i] is the hash of a text's first i code points, sum of (c_k + 1) * B^k modulo 2^31 - 1, for two bases B. The hash
of any span follows from two prefixes, so two spans are compared in constant time and the longest common extension of
two places is found by binary search. A fingerprint keeps the length, the whole text's hash, and 16 bits of the hashes
of the prefixes and suffixes of about 2^(k/4) code points, and length and 24 bits of the hash of each span between cuts.
Cuts are where the hash of the WINDOW code points in front says so, so texts are cut alike wherever they are equal. The
likeness is the share of the longer text that is in equal spans, or in the largest equal prefix and suffix, which are found
by binary search, if that is more.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, released

MODULUS, BASES = np.uint64(2**31 - 1), (911_382_323, 972_663_749)
LENGTHS = np.unique(np.ceil(2 ** (np.arange(0, 160) / 4)).astype(np.int64))
PART_ROWS, MOST_PARTS, SAMPLED = 8192, 16_384, 40
#: Code points that decide on a cut, and one place in how many is one.
WINDOW, APART = 8, 24
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


class Powers:
    """B^k for both bases, extended as texts get longer."""

    def __init__(self):
        self.p = np.ones((2, 1), np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while self.p.shape[1] <= n:
            step = self.p[:, -1:] * np.array(BASES, np.uint64)[:, None] % MODULUS
            self.p = np.concatenate((self.p, self.p * step % MODULUS), axis=1)
        return self.p


POWERS = Powers()


class Prefixes:
    """A text's prefix hashes, 2 x (n + 1)."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.h = np.zeros((2, self.n + 1), np.uint64)
        np.cumsum(codes * POWERS(self.n)[:, : self.n] % MODULUS, axis=1, out=self.h[:, 1:])
        self.h %= MODULUS

    def span(self, start, end, scale: int) -> np.ndarray:
        """Hashes of spans, scaled by B^scale so that spans of equal scale compare; start and end may be arrays up to scale."""
        p = POWERS(scale)
        return (self.h[:, end] + MODULUS - self.h[:, start]) % MODULUS * p[:, scale - np.asarray(start)] % MODULUS


def equal(a: Prefixes, i: int, b: Prefixes, j: int, n: int) -> bool:
    """Whether the n code points from i in a and from j in b are equal (but for one chance in 2**61)."""
    scale = max(i, j)
    return bool((a.span(i, i + n, scale) == b.span(j, j + n, scale)).all())


def extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How many code points from i in a equal those from j in b: binary search over span hashes."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if equal(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def short(h: np.ndarray) -> str:
    """16 bits of each pair of hashes, in hex."""
    return ((h[0] * np.uint64(0x9E3779B1) + h[1]) >> np.uint64(7) & np.uint64(0xFFFF)).astype("<u2").tobytes().hex()


@dataclass
class Joined:
    """The first `keep` code points of one text, then the first `more` of another, without hashing them again."""

    a: Prefixes
    keep: int
    b: Prefixes
    more: int

    @property
    def n(self) -> int:
        return self.keep + self.more

    def prefix(self, at: np.ndarray) -> np.ndarray:
        head = self.a.h[:, np.minimum(at, self.keep)]
        tail = self.b.h[:, np.maximum(at - self.keep, 0)]
        return (head + tail * POWERS(self.keep)[:, self.keep : self.keep + 1]) % MODULUS


def spans(h: np.ndarray) -> str:
    """Length (modulo 2^16) and 24 bits of the hash of each span between a text's cuts, in hex, from its prefix hashes."""
    n = h.shape[1] - 1
    p = POWERS(n)
    start = np.arange(max(0, n - WINDOW))
    window = (h[0, start + WINDOW] + MODULUS - h[0, start]) % MODULUS * p[0, n - start] % MODULUS
    # The scale is the text's length, so B^n is taken out again to make equal windows of any texts equal.
    window = window * np.uint64(pow(int(p[0, n]), -1, int(MODULUS))) % MODULUS
    cuts = start[(window * np.uint64(0x9E3779B1) >> np.uint64(20)) % np.uint64(APART) == 0] + WINDOW
    edges = np.unique(np.concatenate(([0], cuts, [n])))
    a, b = edges[:-1], edges[1:]
    if not len(a):
        return ""
    own = (h[:, b] + MODULUS - h[:, a]) % MODULUS * p[:, n - a] % MODULUS
    own = own * np.array([[pow(int(x), -1, int(MODULUS))] for x in p[:, n]], np.uint64) % MODULUS
    mixed = (own[0] * np.uint64(0x9E3779B1) + own[1]) >> np.uint64(7) & np.uint64(0xFFFFFF)
    return (mixed << np.uint64(16) | (b - a).astype(np.uint64) & np.uint64(0xFFFF)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def fingerprint(text: Prefixes | Joined) -> str:
    """length . hash of the whole . prefixes . suffixes . spans; equal texts have equal ones."""
    n, at = text.n, LENGTHS[LENGTHS <= text.n]
    prefix = text.prefix if isinstance(text, Joined) else lambda k: text.h[:, k]
    whole, starts = prefix(np.array([n])), n - at
    suffix = (whole + MODULUS - prefix(starts)) % MODULUS * POWERS(n)[:, n - starts] % MODULUS
    return f"{n:x}.{int(whole[0, 0]):08x}{int(whole[1, 0]):08x}.{short(prefix(at))}.{short(suffix)}.{spans(text.h if isinstance(text, Prefixes) else prefix(np.arange(n + 1)))}"


def _reach(a: str, b: str) -> int:
    """The largest of LENGTHS at which the hashes in a and b are still equal, by binary search; 0 for none."""
    low, high = 0, min(len(a), len(b)) // 4
    while low < high:
        mid = (low + high + 1) // 2
        if a[4 * mid - 4 : 4 * mid] == b[4 * mid - 4 : 4 * mid]:
            low = mid
        else:
            high = mid - 1
    return int(LENGTHS[low - 1]) if low else 0


def _counted(spans_: str) -> Counter:
    return Counter(spans_[i : i + 10] for i in range(0, len(spans_), 10))


def likeness(a: str, b: str) -> float:
    """0 to 1: shared spans, or common prefix and suffix, of two texts as their fingerprints show them, by the longer text; 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = a.split("."), b.split(".")
    longer = max(int(x[0], 16), int(y[0], 16))
    shared = sum(int(span[6:], 16) * n for span, n in (_counted(x[4]) & _counted(y[4])).items())
    return min(max(shared, _reach(x[2], y[2]) + _reach(x[3], y[3])), longer - 1) / longer


class Chain:
    """Takes documents in order and yields each one's row when the next is there."""

    def __init__(self):
        self.part, self.held, self.closed = None, None, False

    def feed(self, part: int, look: int, doc_id, text: str) -> tuple | None:
        if part != self.part:
            self.part, self.held, self.closed = part, None, False
        if self.closed:
            return None
        own = Prefixes(text)
        now = (doc_id, text, own, fingerprint(own))
        row = self.row(self.held, now) if self.held else None
        self.held, self.closed = now, bool(look)
        return row

    @staticmethod
    def row(this: tuple, after: tuple) -> tuple:
        doc_id, text, own, mark = this
        m = own.n // 2
        edited = Joined(own, own.n - m, after[2], min(m, after[2].n))
        other = fingerprint(edited)
        same = min(extension(own, own.n - m, after[2], 0), edited.more)
        sha = hashlib.sha256((text[: own.n - m] + after[1][:m]).encode()).hexdigest()
        return doc_id, own.n, sha, mark, other, likeness(mark, other), likeness(mark, after[3]), own.n - m + same, extension(own, 0, after[2], 0)


def _run(batches):
    chain = Chain()
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    for b in batches:
        rows = []
        for part, look, doc_id, text in zip(*(b.column(c) for c in ("part", "look", "doc_id", "text")), strict=True):
            row = chain.feed(part.as_py(), look.as_py(), doc_id.as_py(), text.as_py() or "")
            if row:
                rows.append(row)
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _position(doc_id: Column, text: Column) -> Column:
    """Where a row stands, as 32 hex digits that sort like it: doc_id descending, null last, then a hash of the text."""
    back = F.bitwise_not(F.coalesce(doc_id, F.lit(-(2**63)))).bitwiseXOR(F.lit(-(2**63)))
    return F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (back, F.xxhash64(text))])


def _at_or_above(position: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds aren't above a position: a coarse count, then one within the stretch."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= position))
    coarse = count(F.array(*map(F.lit, bounds[step - 1 :: step]))) * step
    return coarse + count(F.slice(F.array(*map(F.lit, bounds)), coarse + 1, F.lit(step)))


def _lanes(spark: SparkSession, parts: int) -> list[int]:
    """A number for each part by whose hash Spark deals it to a partition of its own."""
    lane, found, start = F.pmod(F.hash("id"), F.lit(parts)), {}, 0
    while len(found) < parts:
        some = spark.range(start, start + 16 * parts + 64).select("id", lane.alias("lane")).groupBy("lane").agg(F.min("id").alias("id"))
        for r in some.collect():
            found.setdefault(r["lane"], r["id"])
        start += 16 * parts + 64
    return [found[k] for k in range(parts)]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document, see SCHEMA; the next document is the one of next smaller doc_id, the first after the last.

    Order: doc_id descending, null last, then a hash of the text, so rows that share a doc_id follow one another and
    repeated rows are each other's next. A null text is empty; the only document's next is itself; an empty table gives
    no rows. Columns other than doc_id and text are not read.

    Documents are dealt once, by doc_id and text hash, so that a doc_id that many share is no one task's load, into
    ranges between places of a seeded sample (SAMPLED places a range and MOST_PARTS ranges at most, on the driver), a
    range a task, and streamed in order. A range's last document needs the first of the next range: that is the one at the
    bound, which is dealt to both. Rows equal in doc_id and text stay together; a task holds two texts, however many.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").withColumn("k", _position(F.col("doc_id"), F.col("text")))
    sums = rows.agg(F.count("*").alias("n"), F.min("k").alias("first")).first()
    parts = max(1, min(MOST_PARTS, -(-sums["n"] // PART_ROWS)))
    sample = []
    if parts > 1:
        sample = sorted(r["k"] for r in rows.select("k").orderBy(F.xxhash64("k", F.monotonically_increasing_id())).limit(SAMPLED * parts).collect())
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)} - {sums["first"]}) if sample else []
    part = _at_or_above(F.col("k"), bounds)
    # The first of the whole order closes the last range; the document at a bound closes the range below it.
    before = F.when(F.col("k") == F.lit(sums["first"]), F.lit(len(bounds)))
    if bounds:
        before = before.when(F.col("k").isin(bounds), part - 1)
    lanes = F.array(*map(F.lit, _lanes(spark, len(bounds) + 1)))
    dealt = rows.select("*", F.posexplode(F.array_compact(F.array(part, before))).alias("look", "part")).withColumn("lane", F.element_at(lanes, F.col("part") + 1).cast("long"))
    ordered = dealt.repartition(len(bounds) + 1, "lane").sortWithinPartitions("part", "look", "k")
    return ordered.select("part", "look", "doc_id", "text").mapInArrow(released(_run), SCHEMA)
