"""SimHash near-duplicate groups by anchor-point covering.

The anchors are the words of a covering code: two binary Golay codes of length 23, each of covering radius 3 and perfect,
side by side over the first 46 bits of a fingerprint (the other 18 are left to the comparison). That makes 2**24 anchors.
Each fingerprint has one home, the anchor within the covering radius in both parts. It also visits every anchor that is
further off by the threshold at most: by 2 words in one part, or by one in each. Of two fingerprints at 2 or fewer
differing bits the one visits the other's home, as each differing bit takes it one further away. So every link is found
where a home's fingerprints meet its visitors, 1 + 60 of them on average for each; they are compared on all 64 bits.

A bit for each anchor, 2 MiB at any size of the corpus, says which have fingerprints at home. Visits elsewhere are not
made. An anchor with many visitors is dealt in cells of visitors by homes, so that no task compares more than a part with
a part. Equal fingerprints are one class before all this, and a cell hands on stars of what it has linked, not pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_bytes, blocks, bound_batches, forget, materialize, released
from .minhash import _dealt, _each_salt, _hot, components

WIDTH, DISTANCE, SEED = 3, 2, 42
#: The binary Golay code: length, information bits, covering radius, generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
LENGTH, INFO, RADIUS, GENERATOR = 23, 12, 3, 0b101011100011
#: An anchor with more visitors or homes than this is dealt in cells; more, if the rows are more than this times HOT_ANCHORS.
CELL, HOT_ANCHORS = 4096, 100_000
#: Comparisons at once in a task.
PAIRS = 1 << 21


def fingerprint_texts(texts: list[bytes], width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """The fingerprints of UTF-8 texts: a bit is set if more than half of the shingles' XXH64 have it; zero without words."""
    hash_of, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for t in texts:
        words = t.lower().split()  # of bytes, so A to Z and ASCII white space only
        whole = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        if len(words) > width:
            starts = [0, *(ends[:-width] + 1).tolist()]
            hashes += [hash_of(whole[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
        elif words:
            hashes.append(hash_of(whole, seed))
        sizes.append(max(len(words) - width + 1, min(len(words), 1)))
    return majority(np.array(hashes, np.uint64), np.array(sizes, np.int64))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each group of sizes hashes, the bits that more than half of them have.

    Four bits are counted at once, in the 16-bit lanes of a word, over at most 65,535 hashes.
    """
    out = np.zeros(len(sizes), np.uint64)
    if not len(hashes):
        return out
    full = np.flatnonzero(sizes)
    n = sizes[full]
    parts = -(-n // 65535)
    of = np.repeat(np.arange(len(full)), parts)
    cut = np.repeat(np.cumsum(n) - n, parts) + 65535 * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    first = np.cumsum(parts) - parts
    lanes, low = U64(0x0001000100010001), U64(0xFFFF)
    found = np.zeros(len(full), np.uint64)
    for k in range(16):
        counted = np.add.reduceat((hashes >> U64(k)) & lanes, cut)
        for lane in range(4):
            ones = np.add.reduceat((counted >> U64(16 * lane)) & low, first).astype(np.int64)
            found |= (2 * ones > n).astype(np.uint64) << U64(16 * lane + k)
    out[full] = found
    return out


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator: 11 bits, zero for the code's words."""
    v = v.copy()
    for k in range(LENGTH - 1, LENGTH - INFO - 1, -1):
        v ^= ((v >> k) & 1) * (GENERATOR << (k - (LENGTH - INFO)))
    return v


class Covering:
    """Anchors of 64-bit fingerprints: each one's home, and those further off by the distance at most."""

    def __init__(self, distance: int = DISTANCE):
        self.distance, self.errors, self.at = distance, [], []
        for extra in range(distance + 1):
            weights = range(RADIUS + 1) if not extra else [RADIUS + extra]
            words = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(LENGTH), w)], np.int64)
            s = syndrome(words)
            order = np.argsort(s, kind="stable")
            self.errors.append(words[order])
            self.at.append(np.searchsorted(s[order], np.arange((1 << (LENGTH - INFO)) + 1)))

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = U64((1 << LENGTH) - 1)
        return (x & mask).astype(np.int64), ((x >> U64(LENGTH)) & mask).astype(np.int64)

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The anchors within the covering radius, one for each fingerprint."""
        info = [(p ^ self.errors[0][self.at[0][syndrome(p)]]) >> (LENGTH - INFO) for p in self.parts(x)]
        return (info[0] << INFO) | info[1]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of x, anchors): every anchor within the covering radius and the distance, the home included."""
        a, b = self.parts(x)
        sa, sb = syndrome(a), syndrome(b)
        rows, anchors = [], []
        for i in range(self.distance + 1):
            for j in range(self.distance + 1 - i):
                na, nb = self.at[i][sa + 1] - self.at[i][sa], self.at[j][sb + 1] - self.at[j][sb]
                each = na * nb
                row = np.repeat(np.arange(len(x)), each)
                k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                ea, eb = self.errors[i][self.at[i][sa[row]] + k // nb[row]], self.errors[j][self.at[j][sb[row]] + k % nb[row]]
                rows.append(row)
                anchors.append((((a[row] ^ ea) >> (LENGTH - INFO)) << INFO) | ((b[row] ^ eb) >> (LENGTH - INFO)))
        return np.concatenate(rows), np.concatenate(anchors)


def _prints(width: int, seed: int):
    """mapInArrow: doc_id, text -> doc_id, fp (8 bytes)."""

    def run(batches):
        for b in batches:
            data, offs = as_bytes(b.column("text"))
            whole, found = memoryview(data), [np.zeros(0, np.uint64)]
            for lo, hi in blocks(offs):
                found.append(fingerprint_texts([bytes(whole[offs[i] : offs[i + 1]]) for i in range(lo, hi)], width, seed))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), to_binary(np.concatenate(found))], names=["doc_id", "fp"])

    return run


def to_binary(x: np.ndarray) -> pa.Array:
    """Eight bytes each, highest first."""
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * 8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets.buffers()[1], pa.py_buffer(x.astype(">u8").tobytes())])


def of_binary(col: pa.Array) -> np.ndarray:
    return as_bytes(col)[0].view(">u8").astype(np.uint64)


def _home_anchors(distance: int):
    """mapInArrow: fp -> anchor."""

    def run(batches):
        covering = Covering(distance)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(covering.homes(of_binary(b.column("fp"))))], names=["anchor"])

    return run


def _visits(distance: int, taken):
    """mapInArrow: fp -> key (an anchor that is a home), fp, home (whether of this one)."""

    def run(batches):
        covering, bits = Covering(distance), np.frombuffer(taken.value, np.uint8)
        for b in batches:
            every = of_binary(b.column("fp"))
            for lo in range(0, len(every), 4000):
                x = every[lo : lo + 4000]
                row, anchor = covering.visits(x)
                met = (bits[anchor >> 3] >> (anchor & 7).astype(np.uint8)) & 1 > 0
                row, anchor = row[met], anchor[met]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), to_binary(x[row]), pa.array(covering.homes(x)[row] == anchor)], names=["key", "fp", "home"])

    return run


def stars(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links (i, j), each vertex but the least of its component, with that least one."""
    vertex, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    i, j, root = at[: len(i)], at[len(i) :], np.arange(len(vertex))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (further := new[new] != new).any():
            new[further] = new[new[further]]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(vertex)))
    return vertex[root[own]], vertex[own]


def linked_stars(homes: np.ndarray, fps: np.ndarray, group: np.ndarray, distance: int):
    """Yields stars of fingerprints that link, of rows in order of group: each group's homes meet all its rows."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    at_home = np.flatnonzero(homes)
    of = np.searchsorted(starts, at_home, "right") - 1
    width = sizes[of]
    done, ends = 0, np.cumsum(width)
    while done < len(at_home):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
        n = width[done:upto]
        x = np.repeat(at_home[done:upto], n)
        y = np.repeat(starts[of[done:upto]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = (np.bitwise_count(fps[x] ^ fps[y]) <= distance) & (fps[x] != fps[y])
        if near.any():
            yield stars(fps[x[near]], fps[y[near]])
        done = upto


def _meet(distance: int):
    """mapInArrow, over rows sorted by cell: key, i, j, fp, home -> links (p, x) that connect what any cell links."""

    def out(homes, fps, group):
        for p, x in linked_stars(homes, fps, group, distance):
            yield pa.RecordBatch.from_arrays([to_binary(p), to_binary(x)], names=["p", "x"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cell = np.stack([b.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            new = (b.column("home").to_numpy(zero_copy_only=False), of_binary(b.column("fp")), cell)
            cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1))
            if held and (held[-1][2][-1] != cell[0]).any():  # the cell that was held is whole
                yield from whole(held, out)
                held = []
            if len(cuts):
                last = int(cuts[-1]) + 1
                yield from whole([*held, tuple(c[:last] for c in new)], out)
                held, new = [], tuple(c[last:] for c in new)
            held.append(new)
        if held:
            yield from whole(held, out)

    def whole(parts, out):
        homes, fps, cell = (np.concatenate(c) for c in zip(*parts, strict=True))
        new = np.ones(len(cell), np.int64)
        new[1:] = (cell[1:] != cell[:-1]).any(axis=1)
        yield from out(homes, fps, np.cumsum(new))

    return run


def simhash_prints(docs: DataFrame, *, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): every document's fingerprint, as eight bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(_prints(width, seed)), "doc_id long, fp binary")


def links(classes: DataFrame, *, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """(p, x): links that connect those of the distinct fingerprints fp that differ by `distance` bits at most."""
    spark = classes.sparkSession
    fps = classes.select("fp")
    homes = fps.mapInArrow(released(_home_anchors(distance)), "anchor long")
    # bitmap_bucket_number counts from 1 up; each of the 512 bitmaps is 4 KiB
    pieces = homes.select(F.bitmap_bucket_number("anchor").alias("bucket"), F.bitmap_bit_position("anchor").alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    taken = np.zeros(1 << (2 * INFO - 3), np.uint8)
    for r in pieces:
        # bucket b > 0 has the anchors from (b - 1) * 32768 + 1 on; anchor 0 is bucket 0's
        bits = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        at = np.flatnonzero(bits) + ((r.bucket - 1) * 32768 + 1 if r.bucket > 0 else 0)
        np.bitwise_or.at(taken, at >> 3, (1 << (at & 7)).astype(np.uint8))
    shared = spark.sparkContext.broadcast(taken.tobytes())
    rows = fps.mapInArrow(released(_visits(distance, shared)), "key long, fp binary, home boolean")
    counts = materialize(rows.groupBy("key").agg(F.count("*").alias("v"), F.sum(F.col("home").cast("long")).alias("h")).filter("v > 1"), "sh-anchors")
    part = max(cell, -(-int(counts.agg(F.sum("v")).first()[0] or 0) // HOT_ANCHORS))
    parts = lambda c: (F.floor((F.col(c) - 1) / part) + 1).cast("int")
    hot = F.broadcast(counts.filter(F.col("v") > part).select("key", parts("h").alias("is"), parts("v").alias("js")))
    own = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)
    # A visitor is in its column of every row of cells; at home it is the homes' side of its row, in every column, too.
    cells = F.transform(every("is"), lambda i: F.struct(i.alias("i"), own("js", 1).alias("j"), (F.col("home") & F.col("is").isNull()).alias("home")))
    cells = F.when(F.col("home") & F.col("is").isNotNull(), F.concat(cells, F.transform(every("js"), lambda j: F.struct(own("is", 2).alias("i"), j.alias("j"), F.lit(True).alias("home"))))).otherwise(cells)
    dealt = rows.join(hot, "key", "left").select("key", "fp", F.explode(cells).alias("c")).select("key", "c.i", "c.j", "fp", "c.home")
    met = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(released(_meet(distance)), "p binary, x binary")
    found = materialize(met, "sh-links")
    shared.unpersist()
    forget(counts)
    return found


def simhash_groups(docs: DataFrame, *, width: int = WIDTH, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id that links reach).

    docs needs doc_id and text; other columns are ignored, so their names can't clash. Null and empty texts, and those of
    white space, have fingerprint zero and are linked like any other. Rows with a null doc_id take part; a component's id is
    its smallest id that is not null, or null where it has none. Repeated rows are repeated in the result. An empty table
    gives an empty result. distance is 0 to 4.
    """
    if not 0 <= distance <= 4:
        raise ValueError("distance must be 0 to 4")
    bound_batches(docs.sparkSession)
    prints = materialize(simhash_prints(docs, width=width, seed=seed), "sh-prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("c")), "sh-classes")
    found = links(classes, distance=distance)
    comp = components(found)
    linked = classes.select("fp", "doc_id").join(comp.withColumnRenamed("v", "fp"), "fp")
    least = materialize(linked.groupBy("root").agg(F.min("doc_id").alias("component_id")), "sh-least")
    named = linked.join(least, "root").select("fp", "component_id")
    named = classes.join(named, "fp", "left").select(F.col("fp").alias("key"), "c", F.coalesce("component_id", "doc_id").alias("component_id"))
    hot, part = _hot(classes.select(F.col("fp").alias("key"), "c"), classes_rows(classes))
    one = _each_salt(named, "c", part)
    out = _dealt(prints.withColumnRenamed("fp", "key"), hot, "doc_id").join(one, ["key", "salt"])
    forget(found)
    return out.select("doc_id", F.lower(F.hex("key")).alias("fingerprint"), "component_id")


def classes_rows(classes: DataFrame) -> int:
    """Rows of all classes."""
    return int(classes.agg(F.sum("c")).first()[0] or 0)
