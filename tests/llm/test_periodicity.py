"""Periodic runs against plain loops over every period and place."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from quillmesh.llm.periodicity import periodic_runs, run_digests, text_runs
from quillmesh.llm.queries import op11_periodic_runs

SF = "/root/testdata/sf0.001"


def brute_runs(ws: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by its definition."""
    n, out = len(ws), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(all(ws[x] == ws[x + r] for x in range(s, e - r)) for r in range(1, q)):
                out.add((s, q, e - s))
            i = j
    return [(s, length, q) for s, q, length in sorted(out)]


def brute_row(doc_id: int | None, text: str | None) -> tuple:
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(ws), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    number: dict[str, int] = {}
    runs = brute_runs([number.setdefault(w, len(number)) for w in ws])
    best = None
    for r in runs:
        if best is None or (r[1] * best[2], -r[0], -r[2]) > (best[1] * r[2], -best[0], -best[2]):
            best = r
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def key(row) -> tuple:
    return tuple((x is not None, x) for x in row)


def test_runs_equal_loops_on_random_words():
    r = random.Random(5)
    for _ in range(600):
        texts = []
        for _ in range(r.randint(1, 6)):
            n, k = r.randint(0, 60), r.choice([1, 2, 2, 3, 10])
            ws = [str(r.randrange(k)) for _ in range(n)]
            if r.random() < 0.5 and n:
                a = r.randrange(n)
                p = 1 + (n - a) // r.randint(3, 10)
                ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
            texts.append(ws)
        runs, collapsed = text_runs([" ".join(w).encode() for w in texts])
        for ws, got, kept in zip(texts, runs, collapsed, strict=True):
            want = brute_runs(ws)
            assert [(x["start"], x["length"], x["period"]) for x in got] == want
            gone = {i for s, length, q in want for i in range(s + q, s + length)}
            assert kept.decode() == " ".join(w for i, w in enumerate(ws) if i not in gone)


def test_odd_rows(spark):
    texts = [None, "", " \t\r\n", "a", "a " * 5, "a " * 6, "x a b a b a b a b y", "é z " * 9, "  \x1c   \x1c " * 4, "a b c " * 5 + "a b d " * 5, "q " * 3000 + "r s " * 2000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6]), (None, texts[9]), (None, None), *[(i, "one two three four five six seven eight nine ten " * 3) for i in range(100, 160)]]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, runs string, collapsed int")
    got = sorted(map(tuple, run_digests(docs).collect()), key=key)
    assert got == sorted((brute_row(*r) for r in rows), key=key)
    plain = {r["doc_id"]: r for r in periodic_runs(docs.filter("doc_id < 9")).collect()}
    assert [tuple(x) for x in plain[6]["runs"]] == [(1, 8, 2)] and plain[6]["collapsed"] == "x a b y"
    assert run_digests(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, times=3)


def test_whole_table_equals_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op11_periodic_runs(spark, SF).collect()))
    want = sorted(brute_row(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 20000)
    small = {w[0] for w in want}
    assert len(small) > 100 and len(got) == len(docs)
    assert [g for g in got if g[0] in small] == want
    assert sum(w[1] > 0 for w in want) > 5
