"""Files, datasets, state, reports and streams in temporary folders; and the vault."""

import json

import pytest
from pyspark.sql import functions as F

from quillmesh.api import Vault
from quillmesh.operators import index
from quillmesh.operators.models import MODELS, Model, Registry
from quillmesh.sources import files


@pytest.fixture
def vault(tmp_path):
    for name, text in (("a.md", "one"), ("sub/b.md", "two"), ("sub/deep/c.md", "three"), ("sub/d.txt", "four"), ("eval/e.md", "five"), ("x.tmp", "six"), ("node_modules/f.md", "seven")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def names(df, root):
    return [r.path.split(root + "/")[1] for r in df.collect()]


def test_globs(spark, vault):
    assert names(files.glob_files(spark, vault, "*.md"), vault) == ["a.md", "eval/e.md", "node_modules/f.md", "sub/b.md", "sub/deep/c.md"]
    assert names(files.glob_files(spark, vault, "sub/*.md"), vault) == ["sub/b.md"]
    assert names(files.glob_files(spark, vault, "sub/**/?.md"), vault) == ["sub/b.md", "sub/deep/c.md"]
    assert names(files.glob_files(spark, vault, "*.md", depth=1), vault) == ["a.md", "eval/e.md", "node_modules/f.md", "sub/b.md"]
    assert names(files.glob_files(spark, vault, "*.md", limit=2), vault) == ["a.md", "eval/e.md"]


def test_listing_limits_before_it_sorts(spark, vault):
    got = files.list_files(spark, vault, limit=3, by="size", descending=True).collect()
    assert [(r.title, r.size) for r in got] == [("f", 5), ("e", 4), ("a", 3)]


def test_hash_scan_skips(spark, vault):
    assert sorted(names(files.read_for_hash(spark, vault, ("deep",)), vault)) == ["a.md", "sub/b.md", "sub/d.txt"]


def item(i, **more):
    return json.dumps({"id": i, "query": "q", "answerable": True, "expected_notes": ["n"], **more})


def test_validation_stops_at_enough_right_rows(spark, tmp_path):
    at = tmp_path / "d.jsonl"
    at.write_text("\n".join([item("1"), "{broken", item(""), item("2"), item("3"), "{broken"]))
    got = files.validate_sample(spark, str(at), valid=2).collect()
    assert [r.problem for r in got] == [None, "json", "id", None]
    assert files.validate_sample(spark, str(at), valid=9).count() == 6


def test_dataset_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.jsonl").write_text(f"# c\n{item(str(k))}\n{{broken\n")
    q = files.dataset_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("items").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.id or "", r.problem or "") for r in spark.table("items").collect())
    assert got == [("", "json")] * 3 + [("0", ""), ("1", ""), ("2", "")]


def test_snapshots_and_reports(spark, tmp_path):
    files.write_snapshot(spark, str(tmp_path / "s"), {"model": "m", "mrr": 0.5})
    assert files.read_snapshot(spark, str(tmp_path / "s")).first().mrr == 0.5
    files.write_snapshot(spark, str(tmp_path / "old"), {"model": "m"}, version="0.9")
    with pytest.raises(Exception, match="snapshot version"):
        files.read_snapshot(spark, str(tmp_path / "old")).select("version").collect()
    one = spark.createDataFrame([(3, 0.25)], "items int, mrr double")
    files.write_report(one, one, one.limit(0), str(tmp_path / "r"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r" / "summary_md")).collect())
    assert "| items | 3 |" in text and "| mrr | 0.25 |" in text


def test_state_is_swapped_whole(spark, tmp_path):
    root = str(tmp_path / "state")
    (tmp_path / "state").mkdir()
    assert files.read_state(spark, root) is None
    for k in (1, 2):
        files.write_state(spark.createDataFrame([(k,)], "k int"), root)
        assert files.read_state(spark, root).first().k == k


def test_index_history(spark):
    """Duplicate ids don't matter, as files are known by path; what goes leaves, what comes back is made anew."""
    kind = "path string, content_hash string, mtime double, text string"
    looks = [[("a", "1", 1.0, "x"), ("b", "2", 1.0, "y")], [("a", "1", 1.0, "x"), ("c", "3", 2.0, "z")], [("b", "2", 3.0, "y"), ("c", "4", 3.0, "zz")]]
    i = state = None
    for rows in looks:
        i, state = index.index_step(i, state, spark.createDataFrame(rows, kind), lambda f: f.select("path", "text"))
        assert sorted((r.path, r.text) for r in i.collect()) == sorted((p, t) for p, _, _, t in rows)
    assert index.state_problem(state, 64) is None and index.state_problem(state, 8) == "dimensions" and index.state_problem(None, 64) == "missing"
    assert index.state_problem(state.drop("version"), 64) == "corrupt" and index.state_problem(state.withColumn("version", F.lit(1)), 64) == "version"
    assert index.state_problem(state.withColumn("content_hash", F.lit(None).cast("string")), 64) == "corrupt"


def test_appended_chunks_have_unit_length(spark, tmp_path):
    at = str(tmp_path / "c")
    files.append_chunks(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, embedding array<float>"), at)
    files.append_chunks(spark.createDataFrame([(3, [0.0, 2.0])], "id int, embedding array<float>"), at)
    got = {r.id: [round(x, 5) for x in r.embedding] for r in spark.read.parquet(at).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [0.0, 1.0]}


def test_models():
    r = Registry(Model("k", "org/k", 8))
    assert r.by_key("k") is r.by_id("org/k") and r.by_key("no") is None and [m.key for m in MODELS.all()] == ["hash-1024", "hash-384", "hash-64"]
    with pytest.raises(ValueError):
        r.add(Model("other", "org/k", 8))


def test_vault_and_its_hooks(spark):
    rows = [("a.md", "a", "Alpha", "a", [], "Alpha tells of rivers. [[Beta]] [[Gone]]"), ("b.md", "b", "Beta", "b", [], "Beta tells of mountains and snow."), ("c.md", "c", "Gamma", "c", [], "Nothing of note.")]
    v = Vault(spark.createDataFrame(rows, "path string, id string, title string, basename string, aliases array<string>, content string"))
    seen = []
    off = v.on("before:search", seen.append)
    v.on("after:stats", lambda df: df.withColumn("extra", F.lit(1)))
    assert v.search("mountains snow", 2).first().path == "b.md" and seen == [("mountains snow", 2)]
    off()
    assert v.search("rivers", 1).first().path == "a.md" and len(seen) == 1
    assert v.stats().first().extra == 1 and [r.src_path for r in v.backlinks("beta").collect()] == ["a.md"]
    nodes, edges = v.graph()
    assert nodes.count() == 4 and edges.count() == 2 and v.health().count() == 1 and v.issues().filter("target = 'Gone'").count() == 1
    v.on("error:messages", seen.append)
    with pytest.raises(AttributeError):
        v.messages("x")
    assert len(seen) == 2
