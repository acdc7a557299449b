"""Titles in texts by automata against every span of every text."""

from __future__ import annotations

import random

import pytest

from quillmesh.operators import imports as I
from quillmesh.operators import links as L
from quillmesh.operators import titles as N

SYLLABLES = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "an", "er")]


def word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))


def is_word(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


def brute_hits(notes, titles, least=2, whole=False, overlapping=False):
    owners: dict[str, set] = {}
    for p, t in titles:
        if t is not None and len(t) >= least:
            owners.setdefault(t, set()).add(p)
    by_key: dict[str, list] = {}
    for t in owners:
        by_key.setdefault(t.lower(), []).append(t)
    sizes = sorted({len(k) for k in by_key})
    out = []
    for p, text in notes:
        low, past = (text or "").lower(), {}
        for i in range(len(low)):
            for n in sizes:
                for t in by_key.get(low[i : i + n], ()) if i + n <= len(low) else ():
                    if owners[t] == {p} or (whole and (is_word(text, i - 1) or is_word(text, i + n))) or (not overlapping and i < past.get(t, 0)):
                        continue
                    past[t] = i + n
                    out.append((p, t, i, i + n))
    return sorted(out)


def brute_occurrences(notes, titles):
    texts = dict(notes)
    free = [(p, t, a, b) for p, t, a, b in brute_hits(notes, titles, 3, True) if not any(a < y and b > x for x, y in (m.span() for m in I.PROTECTED.finditer(texts[p])))]
    out: list[tuple] = []
    for h in sorted(free, key=lambda h: (h[0], h[2] - h[3], h[1], h[2])):
        if not any(h[0] == o[0] and h[2] < o[3] and h[3] > o[2] for o in out):
            out.append(h)
    return sorted(out)


def frames(spark, notes, titles):
    return spark.createDataFrame(notes, "path string, content string").repartition(3), spark.createDataFrame(titles, "path string, title string")


def rows(df):
    return sorted((x.path, x.target, x.start, x.end) for x in df.collect())


@pytest.mark.parametrize("shard_chars", [1 << 20, 300_000])
def test_a_hundred_thousand_titles(spark, monkeypatch, shard_chars):
    monkeypatch.setattr(N, "SHARD_CHARS", shard_chars)
    monkeypatch.setattr(N, "NOTES_PART", 60)
    r = random.Random(11)
    named = list(dict.fromkeys(" ".join(word(r) for _ in range(r.randint(1, 3))) for _ in range(150_000)))[:100_000]
    assert len(named) == 100_000
    titles = [(f"t{k}", t.title() if k % 3 else t) for k, t in enumerate(named)]
    notes = []
    for k in range(150):
        ws = [r.choice(named) if r.random() < 0.3 else word(r) for _ in range(r.randint(0, 60))]
        notes.append((f"n{k}", " ".join(ws) + (f" [[{r.choice(named)}]] `{r.choice(named)}`" if k % 4 == 0 else "")))
    n, t = frames(spark, notes, titles)
    assert rows(I.title_occurrences(n, t)) == brute_occurrences(notes, titles)
    assert rows(N.title_hits(n, t)) == brute_hits(notes, titles)


ODD_NOTES = [("a", "Graph graphs GRAPH theory; graph_theory, aa aa aa aa"), ("b", ""), ("c", None), ("d", "İstanbul STRASSE straße \n Ünïcode ünïcode 日本語の日本"), ("e", "[[Graph]] `graph` [x](graph) ```\ngraph\n``` graph")]
ODD_TITLES = [("a", "Graph"), ("b", "graph"), ("b", "aa aa"), ("x", "aa"), ("x", "日本"), ("y", "straße"), ("y", None), ("z", ""), ("z", "g"), ("z", "graph theory"), ("d", "Ünïcode"), ("w", "***")]


@pytest.mark.parametrize("shard_chars", [1 << 20, 12])
def test_odd_titles_and_notes(spark, monkeypatch, shard_chars):
    monkeypatch.setattr(N, "SHARD_CHARS", shard_chars)
    n, t = frames(spark, ODD_NOTES, ODD_TITLES)
    notes = [x for x in ODD_NOTES if x[1] is not None]
    plain = [x for x in notes if x[0] != "d"]  # lower() of the dotted I is longer, so the loops can't place what follows
    for over in (False, True):
        got = [h for h in rows(N.title_hits(n, t, overlapping=over)) if h[0] != "d"]
        assert got == brute_hits(plain, ODD_TITLES, overlapping=over)
    assert [h[1:] for h in rows(N.title_hits(n, t)) if h[0] == "d"] == [("straße", 17, 23), ("日本", 42, 44), ("日本", 46, 48)]
    assert [h for h in rows(I.title_occurrences(n, t)) if h[0] != "d"] == brute_occurrences(plain, ODD_TITLES)
    assert N.title_hits(n.limit(0), t).count() == 0 and N.title_hits(n, t.limit(0)).count() == 0


def test_anchors_of_any_number_of_titles(spark):
    n, t = frames(spark, ODD_NOTES, ODD_TITLES)
    few = [x for _, x in ODD_TITLES if x and x not in ("Ünïcode", "Graph")]  # of case-blind equal titles one is enough
    got = sorted(map(tuple, L.extract_anchors(n.filter("path <> 'd' and path <> 'a'"), t.filter("path <> 'd'")).collect()))
    want = sorted((p, *a) for p, c in ODD_NOTES if p not in "ad" for a in L.anchors_of(c or "", [*few, "Graph"]))
    assert got == want and any(x[4] == "title_match" for x in got)


def test_counts_of_many_titles_shuffle_neither_texts_nor_hits(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD_CHARS", 12)
    n, t = frames(spark, [*ODD_NOTES, ODD_NOTES[0]], ODD_TITLES)
    n = n.localCheckpoint()
    found = N.title_counts(n, t)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted((h[0], h[1]) for x in [*ODD_NOTES, ODD_NOTES[0]] if x[0] != "d" for h in brute_hits([x], ODD_TITLES))
    assert sorted((x.path, x.target) for x in found.collect() if x.path != "d" for _ in range(x.n)) == want
