"""Changes of a tree as a stream, into debounced batches."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from tessera.streaming import watch
from tessera.streaming.changes import FileChangesReader, admitted_changes, file_changes


def write(root, name, text="x"):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(text)


def test_changes_of_a_tree(spark, tmp_path):
    root, state = tmp_path / "r", str(tmp_path / "state")
    write(root, "a.md")
    write(root, "b/c.md")
    write(root, ".git/x.md")
    events = file_changes(spark, str(root), state, "db", "col")

    def start():
        return events.writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()

    def seen():
        return [(r["relative"], r["deleted"]) for r in spark.table("changes").orderBy("seq").collect()]

    query = start()
    try:
        query.processAllAvailable()
        assert sorted(seen()) == [("a.md", False), ("b/c.md", False)]
        write(root, "a.md", "longer")
        os.rename(root / "b" / "c.md", root / "b" / "d.md")
        query.processAllAvailable()
        time.sleep(1)
        query.processAllAvailable()
        assert sorted(seen()[2:]) == [("a.md", False), ("b/c.md", True), ("b/d.md", False)]
    finally:
        query.stop()
    os.remove(root / "a.md")
    reader = FileChangesReader({"root": str(root), "state": state})
    last = reader.latestOffset()
    again = FileChangesReader({"root": str(root), "state": state})
    assert again.latestOffset() == last  # nothing has changed since
    rows = [[r for p in reader.partitions({"listing": last["listing"] - 1}, last) for r in one.read(p)] for one in (reader, again)]
    assert rows[0] == rows[1] and [(r[3], r[4]) for r in rows[0]] == [("a.md", True)]
    silent = FileChangesReader({"root": str(root), "state": str(tmp_path / "none"), "enabled": "false"})
    assert silent.latestOffset() == silent.initialOffset() == {"listing": 0} and silent.partitions({"listing": 0}, {"listing": 0}) == []


def test_changes_are_debounced(spark, tmp_path):
    root = tmp_path / "r"
    write(root, "a.md")
    write(root, "skip.exe")
    events = admitted_changes(file_changes(spark, str(root), str(tmp_path / "state"), "db", "col"), ["no*.md"])
    batches = watch.debounced(events.withWatermark("ts", "0 seconds"), quiet_ms=10, longest_ms=50)
    query = batches.writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for name in ("b.md", "not.md", "c.md", "d.md"):
            query.processAllAvailable()
            time.sleep(0.3)
            write(root, name)
            query.processAllAvailable()
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("quiet").count() < 3:
            time.sleep(0.5)
            query.processAllAvailable()
        got = {r["path"].rsplit("/", 1)[1] for r in spark.table("quiet").collect()}
    finally:
        query.stop()
    assert {"a.md", "b.md"} <= got <= {"a.md", "b.md", "c.md", "d.md"}


def test_replay_of_one_long_session(spark):
    rows = [("d", "c", f"p{k % 40}", k % 7 == 0, k * 500, k) for k in range(3000)] + [("d", "x", f"q{k}", False, 10, k) for k in range(60)] + [("d", "y", None, None, 5, 0)]
    events = spark.createDataFrame(rows, "database string, collection string, path string, deleted boolean, ms long, seq long").withColumn("ts", F.timestamp_millis("ms"))
    found = [tuple(r) for r in watch.debounced_batch(events.repartition(5)).orderBy("collection", "flushed_ms", "path").collect()]
    by = {}
    for _, collection, path, gone, bulk, at in found:
        by.setdefault((collection, at), []).append((path, gone, bulk))
    assert by.pop(("x", 1010)) == [(None, False, True)] and by.pop(("y", 1005)) == [(None, False, False)]
    assert [at for _, at in sorted(by)][:3] == [5000, 10000, 15000] and sum(len(b) for b in by.values()) == 3000
    assert by["c", 5000] == [(f"p{k}", k % 7 == 0, False) for k in range(10)]
