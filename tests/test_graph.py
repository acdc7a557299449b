"""Small note graphs with counts known by hand."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import graph as G
from quillmesh.operators import health as H

SCHEMA = "path string, id string, title string, basename string, aliases array<string>, content string"


def notes(spark, *rows):
    return spark.createDataFrame([(f"{t}.md", t.lower(), t, t.lower().replace(" ", "-"), list(a), c) for t, c, a in ((*r, ())[:3] for r in rows)], SCHEMA)


def resolved(n):
    return G.resolve(G.mentions(n), G.note_keys(n))


def test_same_target_twice_counts_mentions_not_connections(spark):
    n = notes(spark, ("A", "[[B]] and [[B]]"), ("B", ""))
    got = G.graph_stats(n, resolved(n)).first()
    assert (got.note_count, got.unique_connections, got.total_mentions) == (2, 1, 2)


def test_links_resolve_by_title_basename_id_and_alias(spark):
    n = notes(spark, ("A", "[[My Note]] [[my-note]] [[MY_NOTE.md]] [[other name|x]] [[My Note#part|shown]]"), ("My Note", "", ["Other Name"]))
    r = resolved(n).collect()
    assert {x.dst_path for x in r} == {"My Note.md"} and len(r) == 5
    assert [(x.section, x.alias) for x in sorted(r, key=lambda x: x.pos)] == [(None, None), (None, None), (None, None), (None, "x"), ("part", "shown")]


def test_dangling_and_orphans(spark):
    n = notes(spark, ("A", "[[Gone]] [[Gone]] [[gone]]"), ("B", "[[C]]"), ("C", ""), ("D", "no links"))
    r = resolved(n)
    assert {(x.target, x.mentions) for x in G.dangling(r).collect()} == {("Gone", 2), ("gone", 1)}
    assert {x.path for x in G.orphans(n, r).collect()} == {"A.md", "D.md"}


@pytest.mark.parametrize("links,order", [({"A": "[[B]]", "B": "[[C]]", "C": ""}, ["C", "B", "A"]), ({"A": "[[H]]", "B": "[[H]]", "C": "[[H]]", "H": ""}, ["H"])])
def test_pagerank_orders_and_is_normalized(spark, links, order):
    n = notes(spark, *links.items())
    got = {x.path[:-3]: x.score for x in G.pagerank(n, resolved(n)).collect()}
    assert sorted(got, key=got.get, reverse=True)[: len(order)] == order
    assert max(got.values()) == 1 and min(got.values()) >= 0


def test_pagerank_of_a_cycle_and_of_nothing(spark):
    n = notes(spark, ("A", "[[B]]"), ("B", "[[C]]"), ("C", "[[A]]"))
    assert {round(x.score, 6) for x in G.pagerank(n, resolved(n)).collect()} == {1.0}
    empty = n.limit(0)
    assert G.pagerank(empty, resolved(empty)).count() == 0


def test_components_neighbourhood_and_page(spark):
    n = notes(spark, ("A", "[[B]]"), ("B", "[[C]]"), ("C", ""), ("D", "[[E]]"), ("E", ""), ("F", ""))
    r = resolved(n)
    e = G.edges(r)
    comp = G.connected_components(n.select(F.col("path").alias("v")), e.select(F.col("src_path").alias("a"), F.col("dst_path").alias("b")))
    assert {x.v: x.component for x in comp.collect()} == {"A.md": "A.md", "B.md": "A.md", "C.md": "A.md", "D.md": "D.md", "E.md": "D.md", "F.md": "F.md"}
    hop = G.neighbourhood(e, n.filter("path = 'A.md'").select("path"), 2)
    assert {(x.path, x.hops) for x in hop.collect()} == {("A.md", 0), ("B.md", 1), ("C.md", 2)}
    page, links = G.page_of(G.graph_nodes(n, r), G.graph_links(r), 0, 2)
    assert [x.id for x in page.collect()] == ["B.md", "A.md"] and [(x.source, x.target) for x in links.collect()] == [("A.md", "B.md")]


def test_merge_keeps_sections_and_aliases(spark):
    df = spark.createDataFrame([("[[Old]] [[Old#s]] [[Old|shown]] [[Old#s|shown]] [[Other]]",)], "content string")
    assert df.select(G.merge_links("content", ["Old"], "New")).first()[0] == "[[New|Old]] [[New#s|Old]] [[New|shown]] [[New#s|shown]] [[Other]]"


def test_health_and_repair(spark):
    n = notes(spark, ("Alpha", "[[Beta]] [[Beta]] [[Bet]]"), ("Beta", ""))
    r = resolved(n)
    report = H.health_report(n, r).first()
    assert 0 <= report.score <= 100 and report.status in ("healthy", "warning", "critical")
    issues = H.link_issues(n, r)
    dang = issues.filter("kind = 'dangling'").first()
    assert (dang.target, dang.suggested, dang.action) == ("Bet", "Beta", "replace") and abs(dang.confidence - 0.75) < 1e-6
    fixed = H.apply_repairs(n, issues, 0.7).filter("path = 'Alpha.md'").first()
    assert fixed.repaired == "[[Beta]] [[Beta]] [[Beta]]" and fixed.applied == 1


def test_link_issues_read_the_notes_once(spark, tmp_path):
    """What the issues are made of is written, so that no text is searched for links again."""
    at = f"{tmp_path}/notes"
    notes(spark, ("Alpha", "[[Beta]] [[Beta]] [[Bet]]"), ("Beta", "")).write.parquet(at)
    n = spark.read.parquet(at)
    issues = H.link_issues(n, resolved(n))
    assert not [f for f in issues.inputFiles() if at in f]
    assert sorted((x.kind, x.src_path, x.target, x.suggested) for x in issues.filter("kind <> 'hub'").collect()) == [("dangling", "Alpha.md", "Bet", "Beta"), ("duplicate", "Alpha.md", "Beta", None)]


def test_fuzzy_join_and_link_lines_take_every_candidate(spark, tmp_path):
    from quillmesh.plans import registry

    def similarity(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
        return round(1 - row[-1] / max(len(a), len(b)), 6)

    left, right = [f"Supplier#{k:05d}" for k in range(1, 9)], [f"Customer#{k * 7 % 1000:05d}" for k in range(1, 60)]
    spark.createDataFrame(enumerate(left), "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(enumerate(right), "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    want = set()
    for a in left:
        found = sorted((-similarity(a.lower(), b.lower()), b) for b in right)
        want |= {(a, b, -s, k) for k, (s, b) in enumerate(found[:5], 1) if -s >= 0.6}
    got = registry.queries()["levenshtein_fuzzy_join"](spark, str(tmp_path))
    assert {(x.text, x.other, x.similarity, x["rank"]) for x in got.collect()} == want

    spark.createDataFrame([(k, f"text {k}") for k in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = {(x.path, x.target): x.n for x in registry.queries()["link_lines"](spark, str(tmp_path)).collect()}
    assert lines == {(f"notes/doc-{k}.md", t): 1 for k in range(30) for t in (f"doc {(k * 7 + 3) % 33}", f"doc-{(k * 13 + 5) % 33}")}


def test_targets_match_brute_force(spark):
    import random

    from quillmesh.operators import links as L

    r = random.Random(3)
    titles = ["Scripts", "Script", "Script", "Scripting Languages", "Datenbanksystem", "링크가", "東京都市", "x" * 150] + ["".join(r.choice("ab ") for _ in range(r.randint(2, 12))).strip() or "a" for _ in range(40)]
    n = spark.createDataFrame([(f"{k:02d}.md", str(k), t, str(k), [], "# Same head\n" if k % 9 == 0 else "") for k, t in enumerate(titles)], SCHEMA)
    texts = ["Script", "script", "Datenbank", "링크", "東京", "x" * 80, "same head", "Scripting"] + ["".join(r.choice("ab ") for _ in range(r.randint(1, 10))).strip() or "b" for _ in range(30)]
    anchors = spark.createDataFrame([(f"{k % 10:02d}.md", t, 100 * k, 100 * k + len(t), "proper_noun") for k, t in enumerate(texts)], L.ANCHORS)
    want = set()
    for k, t in enumerate(texts):
        t = t.lower()
        exact = max((j for j, o in enumerate(titles) if o.lower() == t), default=None)
        for j, title in enumerate(o.lower() for o in titles):
            ratio = min(len(t), len(title)) / max(len(t), len(title))
            score = max(1.0 if j == exact else 0, 0.85 if t == "same head" and j % 9 == 0 else 0, 0.7 * ratio if (t in title or title in t) and ratio >= 0.5 else 0)
            if score >= 0.3 and j != k % 10:
                want.add((100 * k, f"{j:02d}.md", round(score, 6)))
    got = L.match_targets(anchors, n, k=1000).collect()
    few = L.match_targets(anchors, n, k=2).collect()
    assert {(x.start, x.path, round(x.score, 6)) for x in got} == want and len(got) == len(want)
    for start in {x[0] for x in want}:
        first = sorted((-score, path) for at, path, score in want if at == start)[:2]
        assert sorted((-round(x.score, 6), x.path) for x in few if x.start == start) == first


def test_api_links_take_the_first_node(spark):
    """Title or basename, the first by path; no aliases, no ids."""
    rows = [("b.md", "1", "Same", "b", ["Nick"], "[[Same]] [[a]] [[Nick]] [[2]]"), ("a.md", "2", "same", "a", [], "[[SAME]] [[b]]"), ("c.md", "3", "b", "c", [], "[[none]]")]
    n = spark.createDataFrame(rows, SCHEMA)
    got = {(r.source, r.target) for r in G.graph_links(G.resolve(G.mentions(n), G.node_keys(n))).collect()}
    assert got == {("b.md", "a.md"), ("b.md", "dangling:Nick"), ("b.md", "dangling:2"), ("a.md", "a.md"), ("a.md", "b.md"), ("c.md", "dangling:none")}
