"""Fuzzy joins against all pairs."""

from __future__ import annotations

import random

import pytest

from quillmesh.operators import fuzzy
from quillmesh.plans import registry


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def nearest(left, right, threshold, k):
    want = set()
    for a in {x for x in left if x is not None}:
        found = []
        for b in {x for x in right if x is not None}:
            longest = max(len(a), len(b))
            sim = round(1 - distance(a.lower(), b.lower()) / longest, 6) if longest else 1.0
            if sim >= threshold:
                found.append((-sim, b))
        want |= {(a, b, -s, n) for n, (s, b) in enumerate(sorted(found)[:k], 1)}
    return want


def test_trie_finds_all_within_the_budget(monkeypatch):
    monkeypatch.setattr(fuzzy, "TABLE_CELLS", 40)
    r = random.Random(1)
    for _ in range(60):
        m, n = r.randint(0, 7), r.randint(0, 7)
        right = sorted({"".join(r.choice("abc") for _ in range(m)) for _ in range(20)})
        left = ["".join(r.choice("abc") for _ in range(n)) for _ in range(10)]
        for budget in range(5):
            got = set()
            for at, node, d in fuzzy.Trie(fuzzy.codes_of(right, m)).near(fuzzy.codes_of(left, n), budget):
                got |= {(i, j, x) for i, j, x in zip(at.tolist(), node.tolist(), d.tolist(), strict=True) if x <= budget}
            assert got == {(i, j, distance(x, y)) for i, x in enumerate(left) for j, y in enumerate(right) if distance(x, y) <= budget}


def test_work_grows_less_than_the_product_of_the_sides():
    def steps(n, k):
        trie = fuzzy.Trie(fuzzy.codes_of(sorted(f"customer#{i:09d}" for i in range(k)), 18))
        found = sum(len(at) for at, _, _ in trie.near(fuzzy.codes_of([f"supplier#{i:09d}" for i in range(n)], 18), 7))
        assert found
        return trie.steps

    few, many = steps(100, 1500), steps(400, 6000)  # 16 times the pairs
    assert few < 100 * 1500 and many < 10 * few


@pytest.mark.parametrize(("threshold", "k", "part"), [(0.6, 5, 2048), (0.75, 2, 7), (0.34, 1000, 16)])
def test_candidates_equal_all_pairs(spark, monkeypatch, threshold, k, part):
    monkeypatch.setattr(fuzzy, "RIGHT_PART", part)
    monkeypatch.setattr(fuzzy, "LEFT_PART", 25)
    r = random.Random(int(100 * threshold))
    make = lambda n: ["".join(r.choice("abAB é") for _ in range(r.randint(0, 9))) for _ in range(n)]
    left, right = [*make(60), None, "", "Straße", "日本語"], [*make(90), None, "", "STRASSE", "日本人", "ab", "AB", "Ab"]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    got = fuzzy.fuzzy_candidates(frame(left), frame(right), threshold, k).collect()
    assert {tuple(x) for x in got} == nearest(left, right, threshold, k) and len(got) == len(set(got))


def test_candidates_of_empty_sides(spark):
    some, none = spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([], "text string")
    for left, right in ((some, none), (none, some), (none, none)):
        assert fuzzy.fuzzy_candidates(left, right).collect() == []


def grams(t: str, n: int = 2) -> set[str]:
    t = t.strip(" ").lower()
    return {t} if len(t) < n else {t[i : i + n] for i in range(len(t) - n + 1)}


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, used, mine = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == c:
                used.add(j)
                mine.append(c)
                break
    if not mine:
        return 0.0
    m, theirs = len(mine), [b[j] for j in sorted(used)]
    return (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2) / m) / 3


def composite(a: str, b: str, tokens) -> float:
    x, y = a.strip(" ").lower(), b.strip(" ").lower()
    j = jaro(x, y)
    same = 0
    while same < min(len(x), len(y), 4) and x[same] == y[same]:
        same += 1
    jw = j + 0.1 * same * (1 - j)
    g, h, t, u = grams(a), grams(b), tokens[a], tokens[b]
    dice = 2 * len(g & h) / (len(g) + len(h))
    jac = len(t & u) / len(t | u) if t | u else 0.0
    inside = min(len(x), len(y)) / max(len(x), len(y)) if x and y and (x in y or y in x) else 0.0
    return 0.3 * jw + 0.2 * dice + 0.2 * jac + 0.3 * inside if inside > 0.5 else 0.4 * jw + 0.3 * dice + 0.3 * jac


def all_pairs(spark, texts, threshold):
    from quillmesh.functions import text as T

    texts = sorted({t for t in texts if t is not None})
    tokens = {r.t: set(r.k) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.similarity_tokens("t").alias("k")).collect()}
    scored = {(a, b): round(composite(a, b, tokens), 6) for i, a in enumerate(texts) for b in texts[i + 1 :]}
    return {p: s for p, s in scored.items() if s >= threshold}, len(scored)


@pytest.mark.parametrize("threshold", [0.55, 0.7, 0.9])
def test_similar_pairs_equal_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(fuzzy, "GRAM_ROWS", 4)
    r = random.Random(6)
    words = ["graph", "Graph", "note", "notes", "query plan", "plan", "a", "aa", "aaaa", "aaaaaaa", "", " ", "日本", "日本語", "links", "link"]
    texts = [*words, None, *[" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(70)], *["".join(r.choice("ab ") for _ in range(r.randint(1, 10))) for _ in range(40)]]
    want, _ = all_pairs(spark, texts, threshold)
    got = fuzzy.similar_pairs(spark.createDataFrame([(t,) for t in texts], "target string"), threshold).collect()
    assert {(x.target, x.other): x.similarity for x in got} == pytest.approx(want, abs=2e-6)
    assert len(got) == len(want) > 0


def test_few_pairs_of_all_names_are_formed(spark):
    """All names of the query: the same pairs as from all of them, from a small part of them."""
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    names = part.selectExpr("concat(p_name, ' ', p_brand) as target").distinct()
    texts = [x.target for x in names.collect()]
    want, every = all_pairs(spark, texts[:400], 0.9)
    some = spark.createDataFrame([(t,) for t in texts[:400]], "target string")
    got = fuzzy.similar_pairs(some, 0.9)
    assert {(x.target, x.other): x.similarity for x in got.collect()} == pytest.approx(want, abs=2e-6)
    formed = fuzzy.candidate_pairs(some, 0.9).count()
    print(f"pairs formed: {formed} of {every}, {len(want)} are links")
    assert formed < every / 2
    with pytest.raises(ValueError):
        fuzzy.candidate_pairs(some, 0.4)
    assert fuzzy.similar_pairs(some.limit(0)).count() == 0


def test_clusters_of_all_names(spark):
    """The registered query against components of all pairs."""
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_name", "p_brand").collect()
    names: dict[str, list] = {}
    for x in part:
        names.setdefault(x.p_name, []).append(x.p_brand)
    pairs, _ = all_pairs(spark, names, 0.7)
    up = {n: n for n in names}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    want = set()
    for root in {find(n) for n in names}:
        own = [n for n in names if find(n) == root]
        if len(own) > 1:
            head = min(own, key=lambda n: (-len(names[n]), -len(set(names[n])), n))
            want |= {(head, n, sum(len(names[m]) for m in own)) for n in own}
    got = registry.queries()["similar_link_clusters"](spark, "/root/testdata/sf0.01").collect()
    assert {(x.representative, x.member, x.total) for x in got} == want


def test_a_task_holds_bounded_pairs_and_walks_what_is_near(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(fuzzy, "HELD_PAIRS", 500)
    rows = [f"customer#{i:09d}" for i in range(1500)]
    right = pd.DataFrame({"other": rows, "low": rows, "length": 18})
    asked = [f"supplier#{i:09d}" for i in range(60)]
    held = []
    best = fuzzy._Nearest.best
    monkeypatch.setattr(fuzzy._Nearest, "best", lambda self: held.append(self.size) or best(self))
    left = pd.DataFrame({"text": asked, "low": asked, "length": 18, "bound": 0.6})
    got = fuzzy._pairs(0.6, 5)(left, right)
    want = sorted((a, b, -s) for a, b, s, _ in nearest(asked, rows, 0.6, 5))
    assert sorted((a, b, -s) for a, b, s in got.itertuples(index=False)) == want and len(held) > 1
    steps = []
    near = fuzzy.Trie.near
    monkeypatch.setattr(fuzzy.Trie, "near", lambda self, *a: (yield from near(self, *a)) or steps.append(self.steps))
    for bound in (0.6, 0.666):
        left["bound"] = bound
        assert sorted((a, b, -s) for a, b, s in fuzzy._pairs(0.6, 5)(left, right).itertuples(index=False)) == want
    assert 3 * steps[1] < steps[0]


def test_bounds_are_reached_by_the_k_best(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("aB c") for _ in range(r.randint(0, 9)))
    left, right = [word() for _ in range(60)], [word() for _ in range(80)]
    side = lambda rows, c: spark.createDataFrame([(x,) for x in set(rows)], f"{c} string").selectExpr(c, f"lower({c}) AS low", f"length({c}) AS length")
    kth = {a: s for a, _, s, n in nearest(left, right, 0.4, 2) if n == 2}
    got = {x.text: x.bound for x in fuzzy._bounded(side(left, "text"), side(right, "other"), 0.4, 2).collect()}
    assert all(b <= kth.get(a, 0.4) + 1e-6 for a, b in got.items()) and max(got.values()) > 0.4 and set(got) == set(left)


def test_near_texts_are_joined_without_a_walk(spark, monkeypatch):
    """Where the k best are at distance 1 the right texts are neither bounded nor walked."""
    names = [f"{p}{i}" for i in range(300) for p in ("Doc ", "doc-")]
    left, right = names[400:], names[:400]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    monkeypatch.setattr(fuzzy, "_bounded", lambda *a: pytest.fail("walks"))
    for k in (1, 2):
        got = fuzzy.fuzzy_candidates(frame(left), frame(right), 0.6, k).collect()
        assert {tuple(x) for x in got} == nearest(left, right, 0.6, k) and len(got) == k * len(left)
    assert fuzzy.fuzzy_candidates(frame(["far from it"]), frame(right), 0.93, 1).collect() == []


@pytest.mark.parametrize(("threshold", "k"), [(0.3, 1), (0.5, 2), (0.6, 1), (0.8, 3)])
def test_near_and_far_texts_equal_all_pairs(spark, monkeypatch, threshold, k):
    monkeypatch.setattr(fuzzy, "CLOSE_LENGTH", 5)
    r = random.Random(k)
    make = lambda n: ["".join(r.choice("aAbİ1") for _ in range(r.randint(0, 8))) for _ in range(n)]
    left, right = make(70), make(120)
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    got = fuzzy.fuzzy_candidates(frame(left), frame(right), threshold, k).collect()
    assert {tuple(x) for x in got} == nearest(left, right, threshold, k) and len(got) == len(set(got))
    side = lambda xs, c: spark.createDataFrame([(x,) for x in set(xs)], f"{c} string").selectExpr(c, f"lower({c}) AS low", f"length({c}) AS length", f"length(lower({c})) AS m")
    settled = {x.text for x in fuzzy._close(side(left, "text"), side(right, "other"), threshold, k).collect()}
    assert 0 < len(settled) < len(set(left))  # both ways were taken


def test_no_texts_are_broadcast(spark, monkeypatch):
    """Small written tables whose exploded rows are many: no join but that of the runs' lengths is broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    was, plans, write = spark.conf.get(name), [], fuzzy.materialize
    monkeypatch.setattr(fuzzy, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df, *a))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    left, right = [f"supplier {i:03d}" for i in range(30)], [f"customer {i:03d}" for i in range(80)]
    got = fuzzy.fuzzy_candidates(frame(left), frame(right), 0.5, 3)
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]
    last = got._jdf.queryExecution().sparkPlan().toString()
    assert last.count("BroadcastHashJoin") == 1 and "Join" not in last.replace("BroadcastHashJoin", "")
    assert {tuple(x) for x in got.collect()} == nearest(left, right, 0.5, 3)
    assert spark.conf.get(name) == was
