"""Scalar functions, similarities, chunks, sources and streams on small inputs."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions import similarity as S
from quillmesh.functions import text as T
from quillmesh.functions import vector as V
from quillmesh.operators import chunk, expand, index, links
from quillmesh.operators import retrieve as R
from quillmesh.sources import files
from quillmesh.streaming import jobs


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize("text,want", [("Hello, World! a b2", ["hello", "world", "b2"]), ("한국어 café-x", ["한국어", "café"]), ("", [])])
def test_tokenize(spark, text, want):
    assert one(spark, text, T.tokenize) == want


@pytest.mark.parametrize("title,want", [("My-Note_1.md", "my note 1"), ("  A   B ", "a b"), ("x.MD", "x")])
def test_normalize_title(spark, title, want):
    assert one(spark, title, T.normalize_title) == want


@pytest.mark.parametrize("path,want", [("./Notes/My-Note.md", "notes/my note"), ("/A_b.md", "a b"), ("a\\b", "a/b")])
def test_normalize_path(spark, path, want):
    assert one(spark, path, T.normalize_path) == want


def test_wikilinks_keep_trailing_digits(spark):
    assert one(spark, "[[Doc 10]] [[ Doc 10 ]] [[a#b|c]]", T.wikilink_targets) == ["Doc 10", "a"]


def test_html_to_text(spark):
    assert one(spark, "<script>x</script><p>a &amp; b</p><div>c&nbsp;d</div>", T.html_to_text) == "a & b c d"


@pytest.mark.parametrize("text,want", [("안녕하세요 반갑습니다 여러분", "ko"), ("これはひらがなのぶんしょうです", "ja"), ("这是一个中文句子没有假名的", "zh"), ("plain", "en")])
def test_detect_language(spark, text, want):
    assert one(spark, text, T.detect_language) == want


@pytest.mark.parametrize("a,b,want", [("martha", "marhta", 0.944444), ("dixon", "dicksonx", 0.766667), ("", "", 1.0), ("a", "", 0.0)])
def test_jaro(a, b, want):
    assert abs(S.jaro_value(a, b) - want) < 1e-6


def test_jaro_winkler_is_always_raised(spark):
    df = spark.createDataFrame([("abcdef", "abxyzw")], "a string, b string")
    assert abs(df.select(S.jaro_winkler("a", "b")).first()[0] - 0.644444) < 1e-5


@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_is_symmetric_and_bounded(a, b):
    assert 0 <= S.jaro_value(a, b) <= 1 and abs(S.jaro_value(a, b) - S.jaro_value(b, a)) < 0.26


def test_similarities(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("note", "my note")], "a string, b string")
    got = df.select(S.levenshtein_similarity("a", "b"), S.containment("a", "b"), S.dice("a", "b")).collect()
    assert abs(got[0][0] - (1 - 3 / 7)) < 1e-9 and got[1][0] == 1.0 and abs(got[2][1] - 4 / 7) < 1e-9


def test_cosine_refuses_other_sizes(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in size"):
        df.select(V.cosine("a", "b")).collect()


@given(st.text(alphabet="ab .!?\n#`다", max_size=400))
def test_chunks_lie_within_the_text(text):
    for c in chunk.chunk_text(text, 60, 20):
        assert 0 <= c["start"] < c["end"] <= len(text) and c["content"] == text[c["start"] : c["end"]].strip()


def test_code_blocks_are_not_split():
    code = "```py\n" + "x = 1. \n" * 40 + "```"
    got = chunk.chunk_text("Intro. " * 20 + "\n" + code + "\n" + "Outro. " * 20, 200, 50)
    assert sum(code in c["content"] for c in got) == 1 and any(c["code_languages"] == ["py"] for c in got)


def test_sections_follow_headers():
    got = chunk.chunk_text("---\ntitle: x\n---\npre\n# A\ntext\n## B\nmore")
    assert [(c["header"], c["header_level"]) for c in got] == [(None, None), ("A", 1), ("B", 2)]


def test_anchor_kinds():
    got = {t: k for t, _, _, k in links.anchors_of("We met New York and use GraphDb and API docs, state-of-the-art, not [[New York]].", ["docs"])}
    assert got == {"New York": "proper_noun", "GraphDb": "technical_term", "API": "technical_term", "docs": "title_match", "state-of-the-art": "technical_term"}


def test_expand(spark):
    words = {"developer": ["engineer", "Developer"], "meet": ["gathering"], "지도": ["map"]}
    e = one(spark, "the developer meetup 에서 지도", lambda t: expand.expand_query(t, words, [("developer.*meetup", ["guild"])]))
    assert e.keywords == ["developer", "meetup", "지도"] and e.expansions == ["guild", "engineer", "gathering", "map"]
    lexicon = expand.lexicon_of(spark.createDataFrame([("b", ["x"]), ("a", ["y", "z"])], "key string, related array<string>"))
    assert lexicon == {"a": ["y", "z"], "b": ["x"]}


def test_cdc_scenarios(spark):
    f = spark.createDataFrame([("a", "1", 1.0), ("b", "2", 1.0), ("c", "3", 5.0), ("n", "9", 1.0)], "path string, content_hash string, mtime double")
    m = spark.createDataFrame([("a", "1", 1.0), ("b", "x", 1.0), ("c", "3", 4.0), ("d", "4", 1.0)], "path string, content_hash string, mtime double")
    assert {r.path: r.change for r in index.cdc(f, m).collect()} == {"a": "same", "b": "changed", "c": "changed", "n": "added", "d": "removed"}


def test_embedding_is_deterministic_and_unit(spark):
    df = index.embed(spark.createDataFrame([("x y z",), ("x y z",), (None,)], "content string"))
    got = [r.embedding for r in df.filter("content is not null").collect()]
    assert got[0] == got[1] and abs(sum(v * v for v in got[0]) - 1) < 1e-5


def test_vector_topk_blocks(spark, monkeypatch):
    c = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(10)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "query_id long, vector array<float>")
    whole = sorted(map(tuple, R.vector_topk(c, q, 3).collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, R.vector_topk(c, q, 3).collect())) == whole and len(whole) == 9


def test_markdown_source_and_graph(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a.md").write_text("---\ntitle: Alpha\naliases: [First, One]\ntags:\n  - x\n  - y\n---\n# Alpha\n[[b]]")
    (tmp_path / "sub" / "b.md").write_text("no front matter")
    (tmp_path / ".hidden" / "c.md").write_text("x")
    got = {r.basename: r for r in files.notes(files.read_markdown(spark, str(tmp_path))).collect()}
    assert set(got) == {"a", "b"} and got["a"].title == "Alpha" and got["a"].aliases == ["First", "One"] and got["a"].tags == ["x", "y"] and got["b"].title == "b"


def test_jsonl_quarantine(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text("# comment\n\n" + json.dumps({"id": "1", "query": "q", "answerable": True, "expected_notes": ["a"]}) + "\n{broken\n" + json.dumps({"id": "", "query": "q"}) + "\n")
    good, wrong, counts = files.load_dataset(spark, str(p))
    assert good.count() == 1 and {r.problem for r in wrong.collect()} == {"json", "id"} and counts.first().total == 3


def test_streamed_index(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "path string, content string, mtime double"
    rows = lambda df: chunk.paragraph_chunks(df, "path", "content")
    for k, batch in enumerate([[("a", "one\n\ntwo", 1.0), ("a", "old", 0.0), ("b", "x", 1.0)], [("a", "three", 2.0)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(src))
        files_ = spark.readStream.schema(schema).json(str(src))
        jobs.index_stream(files_, str(out), str(tmp_path / "cp"), rows).awaitTermination()
    assert {(r.path, r.content) for r in jobs.current_index(spark, str(out)).collect()} == {("a", "three"), ("b", "x")}


def test_streamed_windows_match_batch(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001/")
    q = jobs.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    key = [F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n"]
    assert sorted(map(tuple, spark.table("windows").select(*key).collect())) == sorted(map(tuple, jobs.tumbling(events).select(*key).collect()))


def test_hold_out_offsets_point_at_anchors(spark):
    text = "a [[X]] b [[Y|why]] c [[Zed]]"
    got = links.hold_out_links(spark.createDataFrame([("p", text)], "path string, content string"), ratio=1.0).collect()
    plain = links.LINK.sub(lambda m: m[3] or m[1], text)
    assert [plain[r.start : r.end] for r in got] == ["X", "why", "Zed"]
