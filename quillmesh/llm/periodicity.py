"""Periodic runs of words: Karp-Miller-Rosenberg naming, extensions by descending names, candidates on a grid.

Level k names the blocks of 2**k words: names of a level come from sorting pairs of names of the level below, and a block
that no other equals has no name, so ordinary prose has none after a few levels. How far two places agree is then read off
the levels from the highest down, in either direction, for arrays of places at once.

A run of period q and at least 4 q words holds 3 q places whose word recurs q further on. So of the places at multiples of
2 q + 1 one at least starts a block of 2**k <= q words that recurs q further on. Those places are the candidates, n log n
of them in a text of n words, and each is extended to both sides. A stretch found under several periods has the least.

The texts of a block of an Arrow batch are named together. A place without a name stands before each, so no run and no
extension crosses from one text to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, bound_batches, released

#: A run has LEAST words at least and TIMES its period.
LEAST, TIMES = 6, 4
WORD_GAP = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def name_levels(ids: np.ndarray) -> list[np.ndarray]:
    """For each k, names of the blocks of 2**k words from each place; -1 where a block has no equal or a place in it is -1.

    ids are the words' numbers, -1 for a place that equals no other. Levels end with the last that names any block; each
    has one more place than ids, without a name, so that places past the end can be looked up.
    """
    n, levels = len(ids), []
    at = np.flatnonzero(ids >= 0)
    keys = ids[at].astype(np.int64)
    size = 1
    while len(at):
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        at, inverse = at[again], inverse[again]
        if not len(at):
            break
        names = np.full(n + 1, -1, np.int32)
        names[at] = inverse
        levels.append(names)
        at = at[at + 2 * size <= n]
        at = at[names[at + size] >= 0]
        keys = names[at].astype(np.int64) * n + names[at + size]
        size *= 2
    return levels


def agree_after(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from places i on equal those from places j on, where i < j."""
    i, j, long = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a = levels[k][i]
        step = ((a >= 0) & (a == levels[k][j])).astype(np.int64) << k
        i += step
        j += step
        long += step
    return long


def agree_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words up to places i (not with it) equal those up to places j, where i < j; place 0 has no name."""
    i, j, long = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a = levels[k][np.maximum(i - (1 << k), 0)]
        step = ((a >= 0) & (a == levels[k][np.maximum(j - (1 << k), 0)])).astype(np.int64) << k
        i -= step
        j -= step
        long += step
    return long


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0 to c - 1 for each c of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def find_runs(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of all runs, by start, then period, of texts that take sizes places of ids from first on.

    The place before each text is -1 in ids. times is 4 at least, or the grid would miss runs.
    """
    levels, found = name_levels(ids), []
    for k in range(len(levels)):
        of = np.flatnonzero(sizes >= np.maximum(least, times << k))
        if not len(of):
            break
        periods = np.minimum(sizes[of] // times, (2 << k) - 1) - (1 << k) + 1
        doc, q = np.repeat(of, periods), (1 << k) + _ramp(periods)
        points = (sizes[doc] - q - (1 << k)) // (2 * q + 1) + 1
        p, q = np.repeat(first[doc], points) + _ramp(points) * np.repeat(2 * q + 1, points), np.repeat(q, points)
        a = levels[k][p]
        same = (a >= 0) & (a == levels[k][p + q])
        p, q = p[same], q[same]
        s, e = p - agree_before(levels, p, p + q), p + q + agree_after(levels, p, p + q)
        long = e - s >= np.maximum(least, times * q)
        found.append(np.unique(np.stack((s[long], e[long], q[long])), axis=1))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, e, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q = s[new], e[new], q[new]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def text_runs(texts: list[bytes], least: int = LEAST, times: int = TIMES) -> tuple[list[list[dict]], list[bytes]]:
    """For each UTF-8 text its runs, and its words without repetitions, joined by one space."""
    words: list[bytes] = []
    sizes = []
    for t in texts:
        own = t.split()  # ASCII white space only, as these are bytes
        words += own
        sizes.append(len(own))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    sizes = np.array(sizes, np.int64)
    before = np.cumsum(sizes) - sizes
    first = before + np.arange(1, len(sizes) + 1)
    spaced = np.full(len(ids) + len(sizes), -1, np.int64)
    spaced[np.repeat(first, sizes) + _ramp(sizes)] = ids
    s, e, q = find_runs(spaced, first, sizes, least, times)
    doc = np.searchsorted(first, s, "right") - 1
    change = np.bincount(s + q, minlength=len(spaced) + 1) - np.bincount(e, minlength=len(spaced) + 1)
    gone = np.cumsum(change) > 0
    runs: list[list[dict]] = [[] for _ in texts]
    for d, a, length, period in zip(doc.tolist(), (s - first[doc]).tolist(), (e - s).tolist(), q.tolist(), strict=True):
        runs[d].append({"start": a, "length": length, "period": period})
    collapsed = []
    for d, (a, n) in enumerate(zip(before.tolist(), sizes.tolist(), strict=True)):
        own = words[a : a + n]
        if runs[d]:
            own = [own[i] for i in np.flatnonzero(~gone[first[d] : first[d] + n]).tolist()]
        collapsed.append(b" ".join(own))
    return runs, collapsed


def _run_rows(least: int, times: int):
    """mapInArrow: doc_id, text -> doc_id, runs, collapsed."""

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            data, offs = as_bytes(b.column("text"))
            whole, ids = memoryview(data), b.column("doc_id")
            for lo, hi in blocks(offs):
                runs, collapsed = text_runs([bytes(whole[offs[i] : offs[i + 1]]) for i in range(lo, hi)], least, times)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period in words; by start, then period), collapsed (the words but
    those that a run contains after its first period, joined by one space).

    docs needs doc_id and text; other columns are ignored, so their names can't clash. A null or empty text, or one of
    white space, has no words: no runs and an empty collapsed text. Repeated rows and null ids are each answered. An empty
    table gives an empty result. Every text is read whole, in one task; nothing is shuffled. times is 4 at least.
    """
    if times < 4 or least < 1:
        raise ValueError("times must be 4 at least, least 1")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(_run_rows(least, times)), f"doc_id long, runs {RUNS}, collapsed string")


def _looped(text: Column, doc_id: Column) -> Column:
    """text, of one document in ten, as its id's CRC decides, with the end replaced by repetitions of the words from a place on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")

    def cut(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = F.floor(1 + (n - a) / (3 + g % 8)).cast("int")
        return F.concat_ws(" ", F.slice(ws, F.lit(1), a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(ws, a + i % p)))

    looped = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, cut(ws)).otherwise(F.lit("")))[0]
    return F.when(h % 10 == 0, looped).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document its number of runs, the run of greatest length / period, and digests of all runs and of the collapsed text.

    Of one document in ten the end is made to loop first (see _looped); a null doc_id's text stays as it is. Edge cases as
    in periodic_runs; a document without runs has null start, length, period and exponent_milli.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = periodic_runs(rows.select("doc_id", _looped(rows["text"], rows["doc_id"]).alias("text")))
    # Runs come by start, then period, so a later one wins only if its exponent is truly greater.
    best = F.aggregate(
        F.slice("runs", 2, 1 << 30), F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    )
    found = found.withColumn("best", best)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
