"""Exact percentiles and hash trees against sorted lists and plain comparisons."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import merkle, percentiles
from quillmesh.plans import registry


def brute(rows, ps):
    groups: dict = {}
    for g, v in rows:
        groups.setdefault(g, []).extend([] if v is None else [v])
    out = {}
    for g, vs in groups.items():
        vs = sorted(vs, key=lambda v: (math.isnan(v), v))
        at = [p * (len(vs) - 1) for p in ps]
        out[g] = [None] * len(ps) if not vs else [vs[int(a)] if vs[int(a)] == vs[math.ceil(a)] else vs[int(a)] + (a - int(a)) * (vs[math.ceil(a)] - vs[int(a)]) for a in at]
    return out


@pytest.mark.parametrize(("small", "grid", "accuracy"), [(100_000, 1000, 20_000), (5, 1000, 20_000), (5, 10, 10), (20, 7, 3)])
def test_percentiles_equal_sorted_lists(spark, monkeypatch, small, grid, accuracy):
    """Also where sketches are so rough that their bounds miss."""
    for name, v in (("SMALL", small), ("GRID", grid), ("ACCURACY", accuracy)):
        monkeypatch.setattr(percentiles, name, v)
    r = random.Random(small + grid)
    rows = [("a", r.gauss(0, 1) ** 9) for _ in range(700)] + [("b", float(r.randrange(3))) for _ in range(300)] + [(None, 10 ** r.uniform(-200, 200)) for _ in range(100)]
    rows += [("one", 5.0), ("none", None), ("none", None), ("two", 1.0), ("two", 2.0), ("hot", 7.0)] + [("hot", 7.0)] * 400 + [("hot", 8.5)]
    ps = {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x.g: [x[p] for p in ps] for x in percentiles.exact_percentiles(df, "v", ps, ["g"]).collect()}
    want = brute(rows, ps.values())
    assert got.keys() == want.keys()
    for g, values in want.items():
        assert got[g] == [v if v is None else pytest.approx(v, rel=1e-12) for v in values], g
    whole = percentiles.exact_percentiles(df, "v", ps).collect()
    assert [[x[p] for p in ps] for x in whole] == [[pytest.approx(v, rel=1e-12) for v in brute([(0, v) for _, v in rows], ps.values())[0]]]


def test_percentiles_of_odd_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert percentiles.exact_percentiles(df, "v", {"p50": 0.5}, ["g"]).collect() == []
    assert [x.p50 for x in percentiles.exact_percentiles(df, "v", {"p50": 0.5}).collect()] == [None]
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    one = percentiles.exact_percentiles(nan, "v", {"a": 0.5, "b": 1.0}).first()
    assert one.a == 2.0 and math.isnan(one.b)


def test_no_exchange_gathers_a_group(spark, monkeypatch):
    """With few values allowed in a sort, the groups of the query are narrowed down, and its result stays."""
    at = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, registry.queries()["percentile_latency"](spark, at).collect()))
    monkeypatch.setattr(percentiles, "SMALL", 50)
    rounds, real = [], percentiles._narrowed

    def watched(*a):
        out = real(*a)
        rounds.append(out[2])
        return out

    monkeypatch.setattr(percentiles, "_narrowed", watched)
    assert sorted(map(tuple, registry.queries()["percentile_latency"](spark, at).collect())) == whole
    assert rounds and rounds[-1] <= 50


def test_summary_of_slices(spark):
    from quillmesh.operators import metrics as M

    rows = [(k, ["a", "b"], ["b"] if k % 3 else [], k % 4 > 0, float(k), "x" if k % 2 else None, str(k % 3)) for k in range(40)]
    items = M.search_item_metrics(spark.createDataFrame(rows, "id int, retrieved array<string>, expected array<string>, answerable boolean, latency_ms double, kind string, part string"))
    got = sorted((x.kind is not None, x.kind or "", x.part is not None, x.part or "", x["items"], x.p50, x.p95, round(x.mrr or 0, 6)) for x in M.search_summary(items, ["kind", "part"]).collect())
    want = []
    for kinds, parts in ((None, None), ([None], None), (["x"], None), *(([k], [p]) for k in (None, "x") for p in "012")):
        own = [r for r in rows if (kinds is None or r[5] in kinds) and (parts is None or r[6] in parts)]
        use = [r for r in own if r[3] and r[2]]
        ps = brute([(0, r[4]) for r in own], (0.5, 0.95))[0]
        kind, part = kinds[0] if kinds else None, parts[0] if parts else None
        want.append((kind is not None, kind or "", part is not None, part or "", len(own), *map(pytest.approx, ps), 0.5 if use else 0))
    assert got == sorted(want, key=lambda w: w[:5])
    none = M.search_summary(items.limit(0)).collect()
    assert len(none) == 1 and none[0]["items"] == 0 and none[0].p50 is None


def changes(old, new):
    a, b = {}, {}
    for side, rows in ((a, old), (b, new)):
        for k, t in rows:
            if k is not None:
                side.setdefault(str(k), []).append(t)
    key = lambda ts: sorted((t is not None, t or "") for t in ts)
    return {k: "added" if k not in a else "removed" if k not in b else "changed" for k in {*a, *b} if k not in a or k not in b or key(a[k]) != key(b[k])}


@pytest.mark.parametrize("depth", [None, 1, 3])
def test_changed_keys_equal_a_comparison_of_all(spark, depth):
    r = random.Random(2)
    old = [(k, "".join(r.choice("ab") for _ in range(5))) for k in range(400)] + [(7, "again"), (8, None), (None, "x")]
    new = [(k, t if r.random() < 0.9 else f"{t}!") for k, t in old if r.random() < 0.95] + [(k, "new") for k in range(1000, 1010)] + [(8, "")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    a, b = frame(old), frame(new)
    trees = None if depth is None else (merkle.merkle_tree(a, depth=depth), merkle.merkle_tree(b, depth=depth))
    got = merkle.changed_keys(a, b, trees=trees).collect()
    assert {x.key: x.change for x in got} == changes(old, new) and len(got) == len({x.key for x in got})


def test_equal_branches_are_not_walked(spark):
    old = [(k, f"text {k}") for k in range(3000)]
    new = [(k, t + "!" if k in (5, 77) else t) for k, t in old]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (merkle.merkle_tree(frame(x), depth=2) for x in (old, new))
    assert 1 <= merkle.differing_leaves(a, b).count() <= 2 and merkle.differing_leaves(a, a).count() == 0
    again = merkle.merkle_tree(frame(old[::-1]).repartition(5), depth=2)
    assert merkle.differing_leaves(a, again).count() == 0
    root = a.filter("depth = 0").first()
    assert root["rows"] == 3000 and a.filter("depth = 2").agg(F.max("rows")).first()[0] < 60
    with pytest.raises(ValueError):
        merkle.differing_leaves(a, merkle.merkle_tree(frame(old), depth=3))
    none = frame(old).limit(0)
    assert {x.change for x in merkle.changed_keys(none, frame(old[:9])).collect()} == {"added"}
    assert merkle.changed_keys(none, none).count() == 0
