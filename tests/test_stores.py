"""Session store and note files: plans, round trips, and what fails."""

from __future__ import annotations

import json
import os

import pytest

from quillmesh.operators import links
from quillmesh.sources import files, stores


@pytest.fixture
def store(spark, tmp_path):
    stores.register(spark)

    def put(path, session):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(session if isinstance(session, str) else json.dumps(session))

    def session(name, n):
        return {"id": name, "createdAt": f"{name}-c", "updatedAt": f"{name}-u", "tags": ["t"] * (n % 3), "messages": [{"role": "user", "content": f"{name} {k}"} for k in range(n)], "timezone": "UTC", "timezoneOffset": n}

    for k in range(7):
        put(f"2024-0{1 + k % 2}/{k:02d}_101010.json", session(f"2024010{k}_101010", k))
    put("2024-01/30_000000.json", "{ no json")
    put("2024-01/31_000000.json", "[1, 2]")
    put("20231231_235959.json", session("20231231_235959", 2))
    put("2024-01/notes.txt", "no session")
    put("other/1.json", session("x", 1))
    return tmp_path, put, session


def ids(df):
    return sorted(r.id for r in df.collect())


def test_plans_of_the_session_store(spark, store):
    root, put, _ = store
    read = lambda: spark.read.format("session_store").option("files_a_task", 2).load(str(root))
    every = [*[f"2024010{k}_101010" for k in range(7)], "20231231_235959"]
    assert ids(read()) == sorted(every) and {r.planned for r in read().collect()} == {"scan"}
    one = {r.id: r for r in read().collect()}
    assert one["20240103_101010"].month == "2024-02" and [m.content for m in one["20240103_101010"].messages] == [f"20240103_101010 {k}" for k in range(3)]
    assert one["20231231_235959"].month == "2023-12" and one["20240105_101010"].timezone_offset == "5" and one["20240100_101010"].messages == []
    # an index that names some of the files, and one that is gone
    some = {f"2024010{k}_101010": {"path": f"2024-0{1 + k % 2}/{k:02d}_101010.json"} for k in range(5)} | {"gone": {"path": "2024-01/gone.json"}}
    put("index.json", {"version": 1, "sessions": some})
    assert ids(read()) == every[:5] and {r.planned for r in read().collect()} == {"index"}
    assert read().rdd.getNumPartitions() == 3
    for broken in ("{", {"version": 2, "sessions": some}, {"version": 1, "sessions": {}}, {"version": 1}, [1]):
        put("index.json", broken)
        assert ids(read()) == sorted(every) and {r.planned for r in read().collect()} == {"scan"}
    assert ids(spark.read.format("session_store").load(str(root / "nowhere"))) == []


def test_note_copies_round_trip(spark, tmp_path):
    """Notes without their held-out links, written as files and read again."""
    stores.register(spark)
    notes = spark.createDataFrame([(f"a/b{k}.md", f"See [[Note {k}]] and [[x|y]].\nLine é\r\n", k) for k in range(30)] + [("c.md", None, 1), ("d d.md", "", 2)], "path string, content string, n int").repartition(4)
    for _ in range(2):  # writing again leaves the same files
        notes.write.format("note_files").mode("append").save(str(tmp_path))
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".staged")]
    want = {r.path: r.content or "" for r in notes.collect()}
    assert {os.path.relpath(f"{at}/{f}", tmp_path): open(f"{at}/{f}", newline="").read() for at, _, names in os.walk(tmp_path) for f in names} == want
    back = {r.path.split(f"{tmp_path}/")[1]: r.content for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert back == {p: c for p, c in want.items() if c}  # Spark's reader leaves out empty files
    held = links.hold_out_links(notes.filter("content is not null"))
    assert {r.path for r in held.collect()} == {f"a/b{k}.md" for k in range(30)}


@pytest.mark.parametrize("path", ["../out.md", "/etc/out.md", "a/../../out.md", "", None, ".", ".."])
def test_note_files_stay_below_the_root(spark, tmp_path, path):
    stores.register(spark)
    rows = spark.createDataFrame([("ok.md", "x"), (path, "y")], "path string, content string").coalesce(1)
    with pytest.raises(Exception, match="not a path below the root"):
        rows.write.format("note_files").mode("append").save(str(tmp_path / "root"))
    assert [p for _, _, names in os.walk(tmp_path) for p in names] == []


def test_state_is_whole_at_every_step(spark, tmp_path, monkeypatch):
    """A reader between any two steps of a writer sees the old state or the new, also where the writer stops there."""
    root = str(tmp_path / "state")
    old, new = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int")
    files.write_state(old, root)
    files.write_state(old, root)
    seen, real = [], files.file_system

    class Stop(Exception):
        pass

    for stop in (1, 2, 3, 4, 99):
        calls = [0]

        def watched(s, at, calls=calls, stop=stop):
            seen.append(files_state(spark, root, real))
            calls[0] += 1
            if calls[0] == stop:
                raise Stop
            return real(s, at)

        monkeypatch.setattr(files, "file_system", watched)
        try:
            files.write_state(new, root)
        except Stop:
            pass
        monkeypatch.setattr(files, "file_system", real)
        assert files.read_state(spark, root).first().k in (1, 2)
    assert set(seen) == {1, 2} and files.read_state(spark, root).first().k == 2


def files_state(spark, root, real):
    held, files.file_system = files.file_system, real
    try:
        return files.read_state(spark, root).first().k
    finally:
        files.file_system = held


def test_state_that_names_nothing_and_other_failures(spark, tmp_path, monkeypatch):
    root = tmp_path / "state"
    assert files.read_state(spark, str(root)) is None
    root.mkdir()
    (root / f"CURRENT-{1:012d}-v-{'0' * 32}").write_text("")
    assert files.read_state(spark, str(root)) is None  # its folder is gone

    class Broken:
        def parquet(self, *_):
            raise OSError("the store does not answer")

    monkeypatch.setattr(type(spark), "read", Broken())
    with pytest.raises(OSError, match="does not answer"):
        files.read_state(spark, str(root))


def test_required_fields_of_a_snapshot(spark, tmp_path):
    full = {f: "x" for f in files.SNAPSHOT_FIELDS} | {"version": "1.0", "metrics": {"mrr": 0.5}}
    (tmp_path / "full.json").write_text(json.dumps(full))
    assert files.read_snapshot(spark, str(tmp_path / "full.json"), required=files.SNAPSHOT_FIELDS).first().metrics.mrr == 0.5
    (tmp_path / "part.json").write_text(json.dumps({k: v for k, v in full.items() if k not in ("run_id", "config")}))
    with pytest.raises(Exception, match="snapshot lacks run_id, config"):
        files.read_snapshot(spark, str(tmp_path / "part.json"), required=files.SNAPSHOT_FIELDS).collect()
    with pytest.raises(Exception, match="snapshot lacks metrics.p50"):
        files.read_snapshot(spark, str(tmp_path / "full.json"), required=("metrics.p50",)).collect()


def test_markdown_of_a_missing_root_is_empty(spark, tmp_path):
    assert files.read_markdown(spark, str(tmp_path / "nowhere")).collect() == []
    (tmp_path / "bare").mkdir()
    assert files.read_markdown(spark, str(tmp_path / "bare")).collect() == []
