"""SimHash groups by anchors against all pairs and a plain majority of bits."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmesh.llm import simhash as S
from quillmesh.llm.queries import op13_anchor_simhash

SF = "/root/testdata/sf0.001"


def brute_print(text: str | None) -> int:
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] * bool(ws)
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints: list[int], distance: int = 2) -> list[int]:
    """For each, the first index that links reach."""
    up = list(range(len(prints)))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(v) for v in range(len(prints))]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_every_near_fingerprint_visits_the_home():
    covering, r = S.Covering(2), random.Random(3)
    x = np.array([r.getrandbits(64) for _ in range(3000)], np.uint64)
    row, anchor = covering.visits(x)
    of = [set() for _ in x]
    for i, a in zip(row.tolist(), anchor.tolist(), strict=True):
        assert a not in of[i]
        of[i].add(a)
    for k, v in enumerate(x.tolist()):
        for b in r.sample(range(64), r.randint(0, 2)):
            v ^= 1 << b
        assert covering.homes(np.array([v], np.uint64))[0] in of[k]
    assert len(np.unique(S.syndrome(covering.errors[0]))) == len(covering.errors[0]) == 2048  # perfect: one word each


def near_prints(n: int, seed: int) -> list[int]:
    """Clusters, chains of single flips, and 0 and all ones."""
    r, out = random.Random(seed), [0, 2**64 - 1, 1, 3, 7]
    while len(out) < n:
        v = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            out.append(v)
            for b in r.sample(range(64), r.randint(0, 4)):
                v ^= 1 << b
    return list(dict.fromkeys(out))[:n]


@pytest.mark.parametrize(("cell", "distance"), [(4096, 2), (5, 2), (4096, 1), (50, 3)])
def test_links_equal_all_pairs(spark, cell, distance):
    r = random.Random(9)
    hub = r.getrandbits(64)
    dense = [hub ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(120)]  # many at one anchor
    prints = list(dict.fromkeys(near_prints(400, distance) + dense))
    classes = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in prints], "fp binary").repartition(3)
    got = S.links(classes, distance=distance, cell=cell).collect()
    number = {v.to_bytes(8, "big"): i for i, v in enumerate(prints)}
    up = list(range(len(prints)))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for e in got:
        a, b = find(number[bytes(e.p)]), find(number[bytes(e.x)])
        up[max(a, b)] = min(a, b)
    assert [find(v) for v in range(len(prints))] == brute_groups(prints, distance)


def test_majority_of_long_texts():
    r = np.random.default_rng(2)
    hashes = r.integers(0, 2**63, 70_000 * 2 + 3, dtype=np.uint64) * np.uint64(2)
    sizes = np.array([0, 70_000, 0, 3, 70_000, 0])
    at = 0
    for n, got in zip(sizes, S.majority(hashes, sizes).tolist(), strict=True):
        own, at = hashes[at : at + n], at + n
        assert got == sum(1 << b for b in range(64) if 2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > n)


def test_odd_rows(spark):
    texts = [None, "", " \t", "a", "A", "a b", "a  B\n", "a b c", "a b c d e f", "É z é z y", "é Z É z y", "x y z " * 9000, "x y z " * 9001]
    made = [(i + 10, t) for i, t in enumerate(texts)] + [(None, None), (None, "solo text here"), (3, "a b c"), (3, "a b c"), (15, "other words than before")]
    docs = spark.createDataFrame(made, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("key", F.lit(1)).withColumn("c", F.lit(2))
    prints = [brute_print(t) for _, t in made]
    root = brute_groups(prints)
    least = {}
    for (d, _), g in zip(made, root, strict=True):
        least[g] = d if least.get(g) is None else (least[g] if d is None else min(d, least[g]))
    want = [(d, f"{p:016x}", least[g]) for (d, _), p, g in zip(made, prints, root, strict=True)]
    assert rows(S.simhash_groups(docs)) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert rows(S.simhash_groups(docs.limit(0))) == []
    with pytest.raises(ValueError):
        S.simhash_groups(docs, distance=5)


def test_whole_table_equals_all_pairs(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    prints = [brute_print(t) for _, t in docs]
    want = [(d, f"{p:016x}", docs[g][0]) for (d, _), p, g in zip(docs, prints, brute_groups(prints), strict=True)]
    assert rows(op13_anchor_simhash(spark, SF)) == want
