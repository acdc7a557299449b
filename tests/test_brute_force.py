"""Queries that SQL can't express, over whole tables, against independent loops."""

import itertools
import math
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import similarity as S
from quillmesh.operators import links as L
from quillmesh.operators import retrieve as R
from quillmesh.plans import registry
from quillmesh.plans.common import notes

AT = "/root/testdata/sf0.001"


def jaro(a, b):
    """By the two strings' matched positions, each taken once, within the window."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(0, max(len(a), len(b)) // 2 - 1)
    free, pairs = set(range(len(b))), []
    for i in range(len(a)):
        j = next((j for j in sorted(free) if abs(i - j) <= window and a[i] == b[j]), None)
        if j is not None:
            free.discard(j)
            pairs.append((i, j))
    if not pairs:
        return 0.0
    swapped = sum(a[i] != b[j] for (i, _), j in zip(pairs, sorted(j for _, j in pairs), strict=True)) / 2
    return (len(pairs) / len(a) + len(pairs) / len(b) + (len(pairs) - swapped) / len(pairs)) / 3


def winkler(a, b):
    j, n = jaro(a, b), 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return j + n * 0.1 * (1 - j)


def composite(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} or {t}
    words = lambda t: set(re.split(r"[\s\-_.,;:!?'\"()\[\]{}]+", t)) - {""}
    x, y, v, w = grams(a), grams(b), words(a), words(b)
    dice, token = 2 * len(x & y) / (len(x) + len(y)), len(v & w) / len(v | w) if v | w else 0.0
    inside = min(len(a), len(b)) / max(len(a), len(b)) if a and b and (a in b or b in a) else 0.0
    return 0.3 * winkler(a, b) + 0.2 * dice + 0.2 * token + 0.3 * inside if inside > 0.5 else 0.4 * winkler(a, b) + 0.3 * dice + 0.3 * token


def test_jaro_winkler_and_composite_of_all_parts(spark):
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{AT}/part.parquet").collect()}
    got = {r.a: (r.jaro_winkler, r.composite) for r in registry.queries()["jaro_winkler_pairs"](spark, AT).collect()}
    want = {k: (winkler(n.lower(), names[k + 1].lower()), composite(n, names[k + 1])) for k, n in names.items() if k + 1 in names}
    assert got.keys() == want.keys() and all(abs(got[k][i] - want[k][i]) < 1e-5 for k in want for i in (0, 1))


def clusters(targets, threshold):
    up = {t: t for t in targets}

    def find(t):
        while up[t] != t:
            t = up[t]
        return t

    sims = {}
    for a, b in itertools.combinations(sorted(targets), 2):
        s = round(composite(a, b), 6)
        if s >= threshold:
            sims[a, b] = sims[b, a] = s
            x, y = sorted((find(a), find(b)))
            up[y] = x
    groups = {}
    for t in targets:
        groups.setdefault(find(t), []).append(t)
    out = []
    for root, members in groups.items():
        if len(members) > 1:
            first = min(members, key=lambda t: (-targets[t][0], -targets[t][1], t))
            sim = {t: 1.0 if t == first else sims.get((t, first), 0.0) for t in members}
            out += [(root, first, t, round(sim[t], 5), sum(targets[m][0] for m in members), round(sum(sim.values()) / len(members), 4)) for t in members]
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.7, 0.6])
def test_similar_clusters_of_all_part_names(spark, threshold):
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").groupBy(F.col("p_name").alias("target")).agg(F.count("*").alias("occurrences"), F.countDistinct("p_brand").alias("sources"))
    targets = {r.target: (r.occurrences, r.sources) for r in part.collect()}
    key = lambda rows: sorted((r.component, r.representative, r.member, round(r.similarity, 5), r.total, round(r.average, 4)) for r in rows)
    want = clusters(targets, threshold)
    assert key(L.similar_clusters(part, threshold).collect()) == want and want
    one = L.similar_clusters(part, threshold, most=1).collect()
    assert {r.component for r in one} == {min({(-t, c) for c, _, _, _, t, _ in want})[1]}


def test_one_against_all(spark):
    df = spark.createDataFrame([("graph theory",), ("graph  theory",), ("graphs theory",), ("cooking",)], "target string")
    got = [(r.target, r.similarity) for r in L.similar_to(df, "graph theory").collect()]
    want = sorted(((t, round(composite("graph theory", t), 6)) for t in ("graph  theory", "graphs theory", "cooking")), key=lambda x: -x[1])
    assert [(t, round(s, 5)) for t, s in got] == [(t, round(s, 5)) for t, s in want if s >= 0.7]


def test_overlap_ratio(spark):
    df = spark.createDataFrame([("Script", "Scripts"), ("abcdef", "xbcdy"), ("", "a"), ("ab", "cd")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(S.overlap_ratio("a", "b")).collect()] == [round(6 / 7, 6), 0.5, 0.0, 0.0]


def test_keyword_search_in_blocks_equals_all_scores(spark, monkeypatch):
    rows = [(k, k // 2, " ".join(["river", "stone", "light", "word"][(k * i) % 4] for i in range(1, 3 + k % 5))) for k in range(40)] + [(99, 99, None), (98, 98, "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, note_id long, content string")
    queries = spark.createDataFrame([(1, "river stone"), (2, "light"), (3, "absent"), (4, "word word river")], "query_id long, text string")
    terms = R.query_terms(queries)
    key = lambda df: sorted((r.query_id, r.note_id, round(r.score, 5), r["rank"]) for r in df.collect())
    whole = key(R.bm25_best(chunks, terms, 5))
    assert whole == key(R.top_per_query(R.bm25_scores(chunks, terms), 5)) and {q for q, *_ in whole} == {1, 2, 4}
    monkeypatch.setattr(R, "TERM_BLOCK", 1)
    assert key(R.bm25_best(chunks, terms, 5)) == whole
    assert R.bm25_best(chunks.limit(0), terms, 5).count() == 0 and R.bm25_best(chunks, terms.limit(0), 5).count() == 0


def test_keyword_scores_by_hand(spark):
    texts = {1: "the cat sat", 2: "the dog", 3: "a cat and a cat"}
    chunks = spark.createDataFrame([(k, k, t) for k, t in texts.items()], "chunk_id long, note_id long, content string")
    got = {r.note_id: r.score for r in R.bm25_best(chunks, R.query_terms(spark.createDataFrame([(0, "cat")], "query_id long, text string")), 9).collect()}
    mean, idf = sum(map(len, texts.values())) / 3, math.log((3 - 2 + 0.5) / (2 + 0.5) + 1)
    score = lambda tf, n: round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)), 6)
    assert got == {1: score(1, 11), 3: score(2, 15)}


HITS = "query_id long, note_id long, final_score double, title string, preview string"


def test_a_judge_reranks_and_its_failure_keeps_the_order(spark):
    hits = spark.createDataFrame([(q, k, 1 - k / 10, f"T{k}", f"p{k}") for q in (1, 2, 3) for k in range(4)], HITS)

    def judge(prompts):
        return pd.Series(['```json\n{"evaluations": [{"index": 3, "score": 12}, {"index": 1, "score": -4}, {"index": 9, "score": 1}]}\n```' if k == 0 else "no idea" if k == 1 else "" for k, _ in enumerate(prompts)])

    got = R.llm_rerank(hits.filter("query_id = 1"), judge, top=3).orderBy("rank").collect()
    assert [(r.note_id, round(r.reranked_score, 6), r.original_rank) for r in got] == [(0, 1.0, 1), (2, round(0.7 + 0.3 * 0.8, 6), 3), (1, round(0.35 + 0.3 * 0.9, 6), 2), (3, 0.7, 4)]
    failed = R.llm_rerank(hits.filter("query_id = 2"), lambda p: pd.Series(["sorry, no"] * len(p)))
    assert [r.note_id for r in failed.orderBy("rank").collect()] == [0, 1, 2, 3] and failed.filter("reranked_score <> final_score").count() == 0


def test_anchors_and_held_out_links_of_all_notes(spark):
    rows = notes(spark, AT).select("path", "content").collect()
    texts = {r.path: r.content for r in rows}
    got = registry.queries()["extract_anchors"](spark, AT).collect()
    by = {}
    for r in got:
        assert texts[r.path][r.start : r.end] == r.text
        by.setdefault(r.path, []).append((r.start, r.end))
    for path, spans in by.items():
        taken = [m.span() for m in L.LINK.finditer(texts[path])]
        spans.sort()
        assert all(b <= c for (_, b), (c, _) in itertools.pairwise(spans)) and not any(a < y and b > x for a, b in spans for x, y in taken)
    # Every run of capitals outside links is covered by an anchor.
    for path, text in texts.items():
        for m in re.finditer(r"\b[A-Z]{2,6}\b", text, re.A):
            if not any(x <= m.start() < y for x, y in (k.span() for k in L.LINK.finditer(text))):
                assert any(a <= m.start() and m.end() <= b or a < m.end() and b > m.start() for a, b in by.get(path, []))
    held = {}
    for r in registry.queries()["hold_out_links"](spark, AT).collect():
        held.setdefault(r.path, []).append(r)
    assert {p: len(v) for p, v in held.items()} == {p: max(1, int(0.2 * len(L.LINK.findall(t)))) for p, t in texts.items() if L.LINK.search(t)}


def test_anchors_with_titles(spark):
    got = {(t, k) for t, _, _, k in L.anchors_of("the old harbour town and its Harbour", ["Old Harbour", "town", "x"])}
    assert got == {("old harbour", "title_match"), ("town", "title_match")} or ("Harbour", "proper_noun") in got


def test_targets_match_brute_force(spark):
    kind = "path string, id string, title string, basename string, aliases array<string>, content string"
    titles = ["Script", "Scripts", "Type Script Guide", "서울", "서울시청", "Graph", "graph", "Data", "Database Systems", "일정 관리"]
    rows = [(f"n{k:02}.md", f"n{k}", t, f"n{k}", [f"alias {k}"], f"# Head {k % 3}\n") for k, t in enumerate(titles)]
    n = spark.createDataFrame(rows, kind)
    words = ["script", "Scripts", "서울", "head 1", "alias 4", "graph", "database", "Type Script", "일정", "nothing"]
    a = spark.createDataFrame([("n00.md", w, 10 * k, 10 * k + len(w), "noun_phrase") for k, w in enumerate(words)], L.ANCHORS)
    got = {}
    for r in L.match_targets(a, n, k=3).collect():
        got.setdefault(r.text, []).append((r["rank"], r.path, round(r.score, 6)))
    want = {}
    for w in words:
        low, best = w.lower(), {}
        exact = max((p for p, _, t, *_ in rows if t.lower() == low), default=None)
        for p, _, t, _, al, c in rows:
            tl = t.lower()
            scores = [1.0] * (p == exact) + [0.95] * (low in al) + [0.85] * (f"# {low}" in c.lower().split("\n"))
            ratio = min(len(tl), len(low)) / max(len(tl), len(low))
            if (tl in low or low in tl) and ratio >= 0.5:
                scores.append(0.7 * ratio)
            if scores and p != "n00.md":
                best[p] = max(scores)
        order = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3]
        if order:
            want[w] = [(i, p, round(s, 6)) for i, (p, s) in enumerate(order, 1)]
    assert {w: sorted(v) for w, v in got.items()} == want


def test_generated_queries_of_all_notes(spark):
    got = registry.queries()["generated_queries"](spark, AT).collect()
    titles = {r.path: r.title for r in notes(spark, AT).select("path", "title").collect()}
    assert len({r.id for r in got}) == len(got) and {r.expected for r in got} == set(titles)
    assert all(r.topic in r.query for r in got) and all(any(r.topic == titles[p] for r in got if r.expected == p) for p in titles)


def test_sentence_chunks_of_all_notes(spark):
    texts = {r.path: r.content for r in notes(spark, AT).select("path", "content").collect()}
    seen = {}
    for r in registry.queries()["sentence_chunks"](spark, AT).collect():
        assert r.content == texts[r.path][r.start : r.end].strip()
        seen.setdefault(r.path, set()).update(range(r.start, r.end))
    # What no chunk holds is white space.
    assert all(not "".join(c for i, c in enumerate(t) if i not in seen.get(p, ())).strip() for p, t in texts.items())
