"""The watched folder: debounced changes, deletions, restarts and compaction."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quillmesh.streaming import watch

LISTING = "path string, content string, mtime double"


def test_listings_differ(spark):
    before = spark.createDataFrame([("a", "1", 1.0), ("b", "1", 1.0), ("c", None, 1.0), ("d", "1", 1.0)], LISTING)
    now = spark.createDataFrame([("a", "1", 1.0), ("b", "2", 2.0), ("c", None, 3.0), ("e", "1", 1.0)], LISTING)
    got = sorted(map(tuple, watch.listing_events(before, now).collect()))
    assert got == [("b", "2", 2.0, False), ("c", None, 3.0, False), ("d", None, 1.0, True), ("e", "1", 1.0, False)]
    assert watch.listing_events(before, before).count() == 0


@pytest.fixture
def folder(tmp_path):
    events = tmp_path / "events"
    events.mkdir()

    def put(*rows):
        name = f"{time.time_ns()}.json"
        (tmp_path / name).write_text("\n".join(json.dumps(dict(zip(("path", "content", "mtime", "gone"), r, strict=True))) for r in rows))
        os.rename(tmp_path / name, events / name)

    return str(events), put, str(tmp_path / "index"), str(tmp_path / "checkpoint")


def index(spark, root):
    rows = watch.index_now(spark, root)
    return None if rows is None else sorted((r.path, r.word) for r in rows.collect())


def until(spark, root, want, query, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        assert query.exception() is None, query.exception()
        if index(spark, root) == want:
            return
        time.sleep(0.5)
    assert index(spark, root) == want


def words(rows):
    return rows.select("path", F.explode(F.split("content", " ")).alias("word"))


def test_changes_deletions_and_restarts(spark, folder):
    """A file changes thrice, another goes, and a restart gives the same index."""
    source, put, root, checkpoint = folder
    watch.configure(spark)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def start():
        events = spark.readStream.schema(watch.EVENTS).json(source)
        return watch.follow(watch.settled(events), root, checkpoint, words)

    query = start()
    try:
        assert index(spark, root) is None
        put(("a", "one", 1.0, False), ("b", "stays not", 1.0, False), ("a", "one two", 2.0, False))
        put(("a", "one two three", 3.0, None), (None, "x", 1.0, False), ("a", "older", 0.5, False))
        until(spark, root, [("a", "one"), ("a", "three"), ("a", "two"), ("b", "not"), ("b", "stays")], query)
        put(("b", None, 2.0, True), ("c", "new", 1.0, False))
        want = [("a", "one"), ("a", "three"), ("a", "two"), ("c", "new")]
        until(spark, root, want, query)
        query.stop()
        watch.compact(spark, root)
        assert index(spark, root) == want
        query = start()
        time.sleep(2)
        assert index(spark, root) == want
        put(("a", None, 4.0, True), ("d", "later", 1.0, False))
        until(spark, root, [("c", "new"), ("d", "later")], query)
        query.stop()
        before = len(os.listdir(f"{root}/paths"))
        watch.compact(spark, root)
        assert index(spark, root) == [("c", "new"), ("d", "later")] and len(os.listdir(f"{root}/paths")) < before
        watch.compact(spark, root)
        assert index(spark, root) == [("c", "new"), ("d", "later")]
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
