"""Hard negatives by the approximation file against plain loops over all rows."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import negatives as N
from quillmesh.llm.queries import op12_va_negatives

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows) -> list[tuple]:
    """rows (vec_id, embedding, label), no two vec_ids equal."""
    use = []
    for v, e, label in rows:
        if v is not None and e is not None and label is not None and all(x is not None and math.isfinite(x) for x in e):
            single = [struct.unpack("f", struct.pack("f", x))[0] for x in e]
            use.append((v, [math.floor(256 * x) for x in single], (label + 1) % 10 if v % 7 == 0 else label))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, q, label in use:
        if a % 50:
            continue
        scored = sorted((-dot(q, r), v, same == label) for v, r, same in use)
        positives = [(v, -s) for s, v, same in scored if same and v != a][:5]
        for p, ps in positives:
            fits = [(v, -s) for s, v, same in scored if not same and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, k, v, ps, s) for k, (v, s) in enumerate(fits, 1)]
    return sorted(out)


def got(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


def made(n: int, d: int, seed: int, spread: float = 0.2):
    r = random.Random(seed)
    return [(i, [r.gauss(0, spread) for _ in range(d)], r.randrange(4)) for i in range(n)]


@pytest.mark.parametrize(("d", "batch"), [(8, 2000), (7, 30), (1, 50), (64, 400)])
def test_equal_to_loops(spark, monkeypatch, d, batch):
    monkeypatch.setattr(N, "bound_batches", lambda s: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch)))
    monkeypatch.setattr(N, "ANCHOR_BLOCKS", 3)
    rows = made(700, d, d)
    got_rows = got(N.mine_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got_rows == brute(rows) and got_rows


def test_ties_few_values_and_one_hot_vector(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], r.randrange(3)) for i in range(400)]
    rows += [(i, [1.0, 1.0, 0.5], r.randrange(2)) for i in range(400, 650)]
    assert got(N.mine_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(300, 6, 8)
    rows += [(1000, None, 1), (1050, [0.1] * 6, None), (1100, [0.1, None, 0.2], 1), (1150, [nan] * 6, 1), (1200, [inf, 0.1], 1), (1250, [], 1), (None, [0.1] * 6, 1)]
    rows += [(1300, [0.3, 0.2], 1), (1350, [0.3] * 9, 2), (1400, [1e6] * 6, 1), (-50, [0.4] * 6, 3), (-7, [0.4] * 6, 3)]
    assert got(N.mine_negatives(spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("score", F.lit(1)))) == brute(rows)
    # a component that no inner product of long can hold
    assert got(N.mine_negatives(spark.createDataFrame([*rows, (2000, [3e38] * 6, 1)], SCHEMA))) == brute(rows)
    assert got(N.mine_negatives(spark.createDataFrame([], SCHEMA))) == []


def test_repeated_rows_each_take_a_place(spark):
    rows = [(50, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.0], 2), (2, [0.75, 0.0], 2), (50, [1.0, 0.0], 1)]
    found = got(N.mine_negatives(spark.createDataFrame(rows, SCHEMA)))
    assert found == sorted([(50, 1, k, 2, 65536, 49152) for k in (1, 2)] * 4)


def test_bounds_hold_every_score():
    r = np.random.default_rng(3)
    for n, d in ((1, 2), (5, 4), (100, 6), (500, 64)):
        q = r.integers(-500, 500, (n, d))
        codes, lows, highs = N.approximate(q)
        block = N.Block(np.arange(n), np.zeros(n), q, codes, lows, highs)
        a = r.integers(-500, 500, (7, d))
        low, high = block.bounds(a)
        exact = a @ q.T
        assert (low <= exact).all() and (exact <= high).all()


def test_few_rows_are_scored(monkeypatch):
    """Of random vectors the bounds leave a small part to be scored."""
    r, scored = np.random.default_rng(5), []
    q = np.floor(256 * r.normal(0, 0.125, (2000, 64))).astype(np.int64)
    block = N.Block(np.arange(2000), np.zeros(2000), q, *N.approximate(q))
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: scored.append(len(a[1])) or einsum(*a))
    lo, hi = np.full((50, 1), N.NONE), np.full((50, 1), N.ALL)
    a, row, s = N.best_rows(q[:50], block, np.arange(2000) != np.arange(50)[:, None], lo, hi, 5, lo)
    keep = N.first_k(a, s, row, 5)
    exact = q[:50] @ q.T
    np.fill_diagonal(exact, N.NONE)
    assert (np.sort(exact, axis=1)[:, :-6:-1].ravel() == s[keep]).all()
    assert sum(scored) < 0.2 * 50 * 2000


def test_whole_table_equals_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(op12_va_negatives(spark, SF)) == brute(rows)
