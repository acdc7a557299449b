"""Import operators on small notes."""

import pandas as pd

from quillmesh.operators import imports as I

SCHEMA = "path string, id string, title string, basename string, content string"


def test_two_pass_rewrite_keeps_what_was_shown(spark):
    n = spark.createDataFrame([("a.md", "n1", "Alpha", "a", "[[Beta]] [[b|shown]] [[Beta#part]] [[Gone]]"), ("b.md", "n2", "Beta", "b", "")], SCHEMA)
    got = {r.path: r.content for r in I.rewrite_links(n, I.title_mapping(n)).collect()}
    assert got == {"a.md": "[[n2|Beta]] [[n2|shown]] [[n2#part|Beta]] [[Gone]]", "b.md": ""}


def test_titles_are_linked_outside_links_and_code(spark):
    n = spark.createDataFrame([("a.md", "n1", "Alpha", "a", "New York Times, new york, `New York`, [[New York]] and Alpha"), ("b.md", "n2", "New York", "b", ""), ("c.md", "n3", "New York Times", "c", "")], SCHEMA)
    found = I.title_occurrences(n, n)
    assert sorted((r.target, r.start, r.end) for r in found.collect()) == [("New York", 16, 24), ("New York Times", 0, 14)]
    judged = I.judge(found, lambda b: pd.Series([1.0 if t == "New York" else None for t in b["target"]], dtype="float64"))
    done = {r.path: r.content for r in I.apply_links(n, judged.filter("approved")).collect()}
    assert done["a.md"] == "New York Times, [[New York|new york]], `New York`, [[New York]] and Alpha"


def test_images_and_concepts(spark):
    n = spark.createDataFrame([("a.md", "n", "A", "a", "![x](img/p.png) ![y](http://h/q.png) ![[sub/r.png|100]] and Graph here, Graph there")], SCHEMA)
    assert [r.image for r in I.image_references(n).collect()] == ["img/p.png", "sub/r.png"]
    assert I.rewrite_images(n, "assets").first().content.startswith("![x](assets/p.png) ![y](http://h/q.png) ![[assets/r.png|100]]")
    c = spark.createDataFrame([("a.md", "Graph")], "path string, concept string")
    assert I.link_concepts(n, c).first().content.endswith("and [[Graph]] here, Graph there")


def test_generated_queries_do_not_depend_on_order(spark):
    rows = [(f"{k}.md", f"n{k}", f"T{k}", str(k), "# H1\n## H2\n```\n# no\n```\n### H3?\n# H4") for k in range(6)]
    a = sorted(map(tuple, I.generate_queries(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert a == sorted(map(tuple, I.generate_queries(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()))
    assert len(a) == 18 and not any(t == "no" for *_, t in a)
