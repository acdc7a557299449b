"""Near-duplicate groups: MinHash with tensored banding, then exact confirmation of every link.

Tensored banding: a table's key is a pair (A_i, B_j) of half keys, each half key five minhashes. 24 + 24 half keys
(240 minhashes) give 24 * 24 = 576 tables, so hashing costs the square root of what independent tables would. Texts
with Jaccard J share a table with probability (1 - (1 - J^5)^24)^2: 0.9998 at J = 0.8, under 0.0002 at J = 0.22. A half
key that no other text has is dropped before pairs are formed, so texts without near copies form none.

Rows with equal shingle sets are one class. No pair list of a bucket is made. First each bucket's most central member
(its half keys are shared most) meets the others. Then the members of buckets that still hold two components are joined
exactly, by prefix filtering: two sets of J >= t share a token among their rarest |x| - overlap + 1, where the overlap
they need is known for each class of sizes. Edited copies have tokens of their own in front, so they meet few others.
Only pairs across components are formed. Links are confirmed on full 64-bit shingle sets, in integers.

Rows of a key that many share are dealt by salts: a key with more than a HOT_KEYS-th of a table's rows (and LEAST_HOT of
them) is dealt in parts of that size. Fewer than HOT_KEYS keys can be so large, so their list is safe to broadcast, and
what is joined to them is one row a key, repeated for each of its salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, as_bytes, blocks, bound_batches, forget, materialize, mix, released

HALVES, ROWS = 24, 5
#: Keys that can be dealt by salts, at most, and rows of a key up to which it is not.
HOT_KEYS, LEAST_HOT = 100_000, 500
#: Vertices whose edges a task unites at once before labels spread.
FOREST_VERTICES = 200_000


class Shingler:
    """Sets of w-word shingles as sorted distinct 64-bit hashes."""

    def __init__(self, width: int = 4):
        self.words, self.width = Words(), width
        self.odd = np.random.default_rng(7).integers(1, 2**63, width, dtype=np.uint64) * U64(2) + U64(1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        _, _, h, at = self.words(data, offsets)
        w, n = self.width, len(h)
        rolled = np.zeros(max(0, n - w + 1), np.uint64)
        for k in range(w):
            rolled += h[k : n - w + 1 + k] * self.odd[k] if n >= w else 0
        rolled = mix(rolled)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= w:
                yield np.unique(rolled[a : b - w + 1])
            elif b > a:
                yield mix(np.array([(int((h[a:b] * self.odd[: b - a]).sum(dtype=np.uint64)) + 0x5851F42D4C957F2D * int(b - a)) % 2**64], np.uint64))
            else:
                yield rolled[:0]


def set_id(u: np.ndarray) -> bytes:
    """16 bytes that stand for a set: two independent sums over mixed members."""
    return int(mix(u ^ U64(0xA5A5)).sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix(u * U64(0x2545F4914F6CDD1D) + U64(11)).sum(dtype=np.uint64)).to_bytes(8, "big")


class MinHasher:
    """2 * HALVES half keys of a set, each from ROWS minhashes."""

    def __init__(self, halves: int = HALVES, rows: int = ROWS, seed: int = 41):
        r, n = np.random.default_rng(seed), 2 * halves * rows
        self.n, self.rows = n, rows
        self.a = (r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.s = r.integers(0, 2**32, n, dtype=np.uint32)[:, None]
        self.odd = r.integers(1, 2**63, rows, dtype=np.uint64) * U64(2) + U64(1)

    def __call__(self, u: np.ndarray) -> np.ndarray:
        low = np.full(self.n, 0xFFFFFFFF, np.uint32)
        x = (u >> U64(32)).astype(np.uint32)
        for k in range(0, len(x), 1024):
            m = (x[None, k : k + 1024] ^ self.s) * self.a
            m ^= m >> np.uint32(15)
            m *= np.uint32(0x2C1B3C6D)
            m ^= m >> np.uint32(13)
            np.minimum(low, m.min(axis=1), out=low)
        halves = (low.reshape(-1, self.rows).astype(np.uint64) * self.odd).sum(axis=1, dtype=np.uint64)
        return mix(halves + np.arange(len(halves), dtype=np.uint64)).view(np.int64)


def _signatures(width: int, halves: int, rows: int):
    """mapInArrow: rid, doc_id, text -> rid, doc_id, n_shingles, sid, half keys."""

    def run(batches):
        shingles, minhash = Shingler(width), MinHasher(halves, rows)
        for b in batches:
            data, offs = as_bytes(b.column("text"))
            n, sids, keys = [], [], []
            for lo, hi in blocks(offs):
                for u in shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]):
                    n.append(len(u))
                    sids.append(set_id(u) if len(u) else None)
                    keys.append(minhash(u) if len(u) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["rid", "doc_id", "n_shingles", "sid", "halves"],
            )

    return run


def _sets(width: int):
    """mapInArrow: sid, text -> sid and its set; a row whose text has another set is not the one asked for."""

    def run(batches):
        shingles = Shingler(width)
        for b in batches:
            data, offs = as_bytes(b.column("text"))
            want, got, ids = b.column("sid").to_pylist(), [], []
            for lo, hi in blocks(offs):
                for i, u in zip(range(lo, hi), shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), strict=True):
                    if set_id(u) == want[i]:
                        ids.append(want[i])
                        got.append(u.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(got, pa.binary())], names=["sid", "members"])

    return run


def _confirm(percent: int):
    """mapInArrow: pairs of sets -> the pairs whose Jaccard reaches the threshold, in integers."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("pm"), b.column("xm"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("p"), b.column("x")], names=["p", "x"]).filter(pa.array(keep, pa.bool_()))

    return run


def _forests(batches):
    """mapInArrow: edges -> edges of stars that connect the same vertices, for each FOREST_VERTICES of a task's."""
    up: dict[bytes, bytes] = {}

    def find(v: bytes) -> bytes:
        while up.setdefault(v, v) != v:
            up[v] = v = up[up[v]]
        return v

    def stars() -> pa.RecordBatch:
        vs = [v for v in up if up[v] != v]
        return pa.RecordBatch.from_arrays([pa.array([find(v) for v in vs], pa.binary()), pa.array(vs, pa.binary())], names=["p", "x"])

    for b in batches:
        for x, y in zip(b.column("p").to_pylist(), b.column("x").to_pylist(), strict=True):
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
        if len(up) > FOREST_VERTICES:
            yield stars()
            up.clear()
    if up:
        yield stars()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) of the graph of edges (p, x): smallest reachable label of every vertex with an edge to another.

    Each task first replaces its edges by stars, which takes most of the way at any size. Then labels spread by
    propagation with pointer jumping, each round's labels a written table, until none changes. An empty table gives none.
    """
    stars = edges.select("p", "x").mapInArrow(released(_forests), "p binary, x binary")
    both = materialize(stars.select(F.explode(F.array(F.struct("p", "x"), F.struct(F.col("x").alias("p"), F.col("p").alias("x")))).alias("e")).select("e.p", "e.x").distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("p").alias("v")).agg(F.least(F.min("x"), F.col("p")).alias("root")), "cc-labels")
    for _ in range(rounds):
        near = both.join(labels, both.x == labels.v).groupBy(both.p.alias("v")).agg(F.min("root").alias("seen"))
        step = labels.join(near, "v").select("v", F.least("root", "seen").alias("root"), F.col("root").alias("was"))
        jump = labels.select(F.col("v").alias("root"), F.col("root").alias("further"))
        new = materialize(step.join(jump, "root").select("v", F.least("root", "further").alias("root"), "was"), "cc-labels")
        changed = new.filter("root <> was").limit(1).count()
        forget(labels)
        labels = new
        if not changed:
            forget(both)
            return labels.select("v", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _hot(counts: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Of counts (key, c) that sum to `rows` at most, the keys with more rows than a part has, and a part's rows."""
    part = max(LEAST_HOT, -(-rows // HOT_KEYS))
    return F.broadcast(counts.filter(F.col("c") > part).select("key", (F.floor(F.col("c") / part) + 1).cast("int").alias("salts"))), part


def _dealt(rows: DataFrame, hot: DataFrame, by: str = "sid") -> DataFrame:
    """rows with the salt of each row's part of its key."""
    return rows.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")


def _spread(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows, each repeated for every salt of its key."""
    return rows.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def _each_salt(one: DataFrame, c: str, part: int) -> DataFrame:
    """One row a key, with a count, for each of its salts."""
    salts = F.when(F.col(c) > part, F.floor(F.col(c) / part) + 1).otherwise(1).cast("int")
    return one.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))


def row_key(docs: DataFrame) -> Column:
    """64 bits that stand for a row's doc_id and text, each of which may be null."""
    return F.xxhash64(docs["doc_id"], docs["doc_id"].isNull(), docs["text"], docs["text"].isNull())


def _head() -> Column:
    """The row of smallest doc_id, null last, then of smallest key."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))


def near_duplicates(docs: DataFrame, *, width: int = 4, percent: int = 80, halves: int = HALVES, rows: int = ROWS, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept; with `keyed`, rid (row_key)
    and stays: whether that is the one row key of its group to stay (of smallest doc_id, null last), or has no shingles.

    docs needs doc_id and text; other columns are ignored, so their names can't clash. Null and empty texts have no
    shingles, are linked with nothing and are kept. Rows with a null doc_id take part; a component's id is its smallest
    non-null doc_id, and where it has none its rows are all kept with a null component_id. Repeated rows are repeated in
    the result. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows_in = docs.select(row_key(docs).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(rows_in.mapInArrow(released(_signatures(width, halves, rows)), "rid long, doc_id long, n_shingles long, sid binary, halves array<long>"), "mh-signed")
    filled = signed.filter("n_shingles > 0")
    # One row per class of equal sets. The half keys depend on the set alone, so any row's will do; its head is a row that can be found again.
    classes = materialize(
        filled.groupBy("sid").agg(_head().alias("h"), F.any_value("n_shingles").alias("n"), F.any_value("halves").alias("halves")).select("sid", "h.doc_id", "h.rid", "n", "halves"), "mh-classes"
    )
    half = classes.select("sid", "n", F.posexplode("halves").alias("pos", "key"))
    alive = half.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    hot, part = _hot(alive, 2 * halves * classes.count())
    half, alive = _dealt(half, hot), _each_salt(alive, "c", part)
    pick = lambda on: F.collect_list(F.when(on, F.col("key")))
    sides = half.join(alive, ["key", "salt"]).groupBy("sid", "n").agg(pick(F.col("pos") < halves).alias("a"), pick(F.col("pos") >= halves).alias("b"), F.sum("c").alias("c"))
    # Centrality above a hash that breaks ties, in one long.
    rank = F.shiftleft(F.least("c", F.lit(1 << 30)), 32) + F.pmod(F.xxhash64("sid"), F.lit(1 << 32))
    tensor = sides.select("sid", "n", rank.alias("u"), F.explode("a").alias("a"), "b").select("sid", "n", "u", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("key"), "sid", "n", "u")
    sized = materialize(tensor.groupBy("key").agg(F.count("*").alias("c"), F.max("u").alias("first")).filter("c > 1"), "mh-sizes")
    hot, part = _hot(sized, int(sized.agg(F.sum("c")).first()[0] or 0))
    buckets = materialize(_dealt(tensor, hot).join(_each_salt(sized, "c", part), ["key", "salt"]), "mh-buckets")
    sets = materialize(_member_sets(rows_in, classes, buckets, width), "mh-sets")
    pivots = _each_salt(buckets.filter("u = first").select("key", "c", F.col("sid").alias("p"), F.col("n").alias("pn")), "c", part).drop("c")
    meet = buckets.join(pivots, ["key", "salt"]).filter((F.col("sid") != F.col("p")) & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")))
    links = materialize(_confirmed(sets, meet.select(F.least("p", "sid").alias("p"), F.greatest("p", "sid").alias("x")).distinct(), percent), "mh-links")
    comp = components(links)
    rooted = buckets.select("key", "salt", "sid").join(comp, buckets.sid == comp.v, "left").select("key", "salt", "sid", F.coalesce("root", "sid").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("c")).filter("r0 <> r1 and c > 2").select("key", "c")
    open_ = materialize(rooted.join(_each_salt(mixed, "c", part).drop("c"), ["key", "salt"], "left_semi").select("sid", "root").distinct(), "mh-open")
    if open_.limit(1).count():
        pairs, used = _prefix_pairs(sets.join(open_, "sid"), percent)
        found = materialize(_confirmed(sets, pairs, percent), "mh-links")
        forget(*used)
        comp = components(links.union(found))
        forget(found)
    # Only linked classes are named by their root; written first, so that Spark can split a component that is a third of them.
    linked = classes.select("sid", "doc_id", "rid").join(comp.withColumnRenamed("v", "sid"), "sid")
    least = materialize(linked.groupBy("root").agg(_head().alias("h")), "mh-least")
    named = linked.join(least, "root").select("sid", "h")
    alone = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    named = classes.select("sid", alone.alias("own")).join(named, "sid", "left").select("sid", F.coalesce("h", "own").alias("h")).select("sid", F.col("h.doc_id").alias("component"), F.col("h.rid").alias("head"))
    own = signed.withColumn("sid", F.coalesce("sid", F.unhex(F.hex("rid"))))
    out = own.join(named, "sid", "left").select(
        "rid",
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n_shingles") == 0) | (F.col("rid") == F.col("head"))).alias("stays"),
    )
    forget(sized, buckets, sets, open_, links)
    result = out.select(*["rid", "stays"] * keyed, "doc_id", "n_shingles", "component_id", (F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
    result._written = [signed, classes, least]  # for callers that write the result themselves
    return result


def _member_sets(rows_in: DataFrame, classes: DataFrame, buckets: DataFrame, width: int) -> DataFrame:
    """(sid, members): the set of each class that shares a bucket, from a row of the class."""
    rids = buckets.select("sid").distinct().join(classes.select("sid", "rid"), "sid")
    return rows_in.select("rid", "text").join(rids, "rid").select("sid", "text").mapInArrow(released(_sets(width)), "sid binary, members binary").dropDuplicates(["sid"])


def _size_class(n: Column) -> Column:
    """Classes of sizes about a twentieth apart."""
    return F.floor(F.log(n.cast("double")) / F.lit(0.05)).cast("int")


def _need(x: Column, y: Column, percent: int) -> Column:
    """The overlap that sizes x and y need to reach the threshold, or one less where rounding could ask too much."""
    return F.floor(F.lit(percent / (100.0 + percent)) * (x + y) - F.lit(1e-6)).cast("int")


def _tokens(batches):
    """mapInArrow: sets -> one row per member."""
    for b in batches:
        sizes = [len(m) // 8 for m in b.column("members").to_pylist()]
        for k, n in enumerate(sizes):
            token = pa.Array.from_buffers(pa.int64(), n, [None, b.column("members")[k].as_buffer()])
            same = lambda name, k=k, n=n: pa.repeat(b.column(name)[k], n)
            yield pa.RecordBatch.from_arrays([same("sid"), same("root"), pa.array(np.full(n, n, np.int32)), token], names=["sid", "root", "n", "token"])


def _prefix_pairs(sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """All pairs (p, x) of sets of different roots that can reach the threshold, and few more; and the written tables behind them.

    Tokens are ordered by how many of these sets have them. A longer (or equal) set probes each class of sizes of the
    shorter with as many of its rarest tokens as that class needs; the shorter is filed under the fewest it needs. In a
    token's file the most common root's members meet only the others.
    """
    tokens = materialize(sets.mapInArrow(released(_tokens), "sid binary, root binary, n int, token long"), "mh-tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    ranked = tokens.join(often, "token", "left").groupBy("sid", "root", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "token"))).alias("t"))
    ranked = ranked.select("sid", "root", "n", F.slice("t", F.lit(1), F.col("n") - F.ceil(F.col("n") * (percent / 100.0) - 1e-6).cast("int") + 1).alias("t"))
    flat = materialize(ranked.select("sid", "root", "n", F.posexplode("t").alias("i", "t")).filter("t.c > 1").select("sid", "root", "n", "i", F.col("t.token").alias("token")), "mh-prefix")
    filed = flat.filter(F.col("i") <= F.col("n") - _need(F.col("n"), F.col("n"), percent)).select(F.xxhash64("token", _size_class(F.col("n"))).alias("key"), F.col("sid").alias("y"), F.col("root").alias("yr"), F.col("n").alias("yn"), F.col("i").alias("j"))
    classes = F.sequence(_size_class(F.col("n") * (percent / 100.0) - 1e-6), _size_class(F.col("n")))
    asked = flat.select("*", F.explode(classes).alias("class"))
    least = F.greatest(F.ceil(F.exp(F.col("class") * 0.05) - 1e-6), F.ceil(F.col("n") * (percent / 100.0) - 1e-6)).cast("int")
    asked = asked.filter(F.col("i") <= F.col("n") - _need(F.col("n"), least, percent)).select(F.xxhash64("token", "class").alias("key"), "sid", "root", "n", "i")
    counts = filed.groupBy("key", F.col("yr").alias("root")).agg(F.count("*").alias("c"))
    major = materialize(counts.groupBy("key").agg(F.max_by("root", "c").alias("major"), F.sum("c").alias("c")), "mh-major")
    often = asked.groupBy("key").agg(F.count("*").alias("a")).join(major, "key").select("key", F.greatest("a", "c").alias("c"))
    often = materialize(often.filter(F.col("c") > LEAST_HOT), "mh-often")
    hot, _ = _hot(often, int(often.agg(F.sum("c")).first()[0] or 0))
    every = _spread(major.select("key", F.col("major").alias("am")), hot)
    filed, asked = _dealt(filed, hot, "y").join(every, ["key", "salt"]).withColumnRenamed("am", "major"), _dealt(asked, hot).join(every, ["key", "salt"])
    fits = (
        (F.col("root") != F.col("yr"))
        & ((F.col("n") > F.col("yn")) | ((F.col("n") == F.col("yn")) & (F.col("sid") > F.col("y"))))
        & (100 * F.col("yn") >= percent * F.col("n"))
        & (F.least(F.col("n") - F.col("i"), F.col("yn") - F.col("j")) >= _need(F.col("n"), F.col("yn"), percent))
    )
    one = _spread(asked.filter("root <> am").drop("salt"), hot).join(filed, ["key", "salt"]).filter(fits)
    two = asked.filter("root = am").join(_spread(filed.filter("yr <> major").drop("salt"), hot), ["key", "salt"]).filter(fits)
    cols = (F.least("sid", "y").alias("p"), F.greatest("sid", "y").alias("x"))
    return one.select(*cols).union(two.select(*cols)).distinct(), [tokens, flat, major, often]


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (p, x) whose full sets reach the threshold."""
    left = pairs.join(sets.select(F.col("sid").alias("p"), F.col("members").alias("pm")), "p")
    full = left.join(sets.select(F.col("sid").alias("x"), F.col("members").alias("xm")), "x")
    return full.select("p", "x", "pm", "xm").mapInArrow(released(_confirm(percent)), "p binary, x binary")
