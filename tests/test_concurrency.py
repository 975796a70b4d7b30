"""Commits that meet, and batches that are run again or lost halfway."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators.snapshots import LostUpdate, Snapshots
from tessera.operators.store import ChunkStore
from tessera.schema import CHUNKS, migrate
from tessera.streaming.flush import chunk_sink


def chunks(spark, *names, collection="c", n=2):
    rows = [(name, collection, k, f"{name} {k}") for name in names for k in range(n)]
    return migrate(spark.createDataFrame(rows, "document_name string, collection string, chunk_index int, text string").withColumn("page_number", F.lit(1)))


def names(store):
    return sorted(r[0] for r in store.read().select("document_name").distinct().collect())


def meanwhile(store, act):
    """``act`` runs once between what ``store`` reads and its commit."""
    write, done = store._write, []

    def slow(*args, **kwargs):
        made = write(*args, **kwargs)
        if not done:
            done.append(1)
            act()
        return made

    store._write = slow


def test_snapshots_follow_what_was_read(spark, tmp_path):
    one, other = (Snapshots(spark, str(tmp_path / "s")) for _ in range(2))
    assert one.commit({"a": 1}, 0) == 1
    with pytest.raises(LostUpdate):
        other.commit({"b": 1}, 0)
    open(tmp_path / "s" / "claim-snapshot-2", "w").close()  # of a writer that is at work, or was lost
    with pytest.raises(LostUpdate):
        other.commit({"b": 1}, 1)
    other.stale = 0.0
    assert other.commit({"b": 1}, 1) == 2 and one.latest({}) == (2, {"b": 1})
    assert one.update(lambda s: s | {"c": 2}, {}) == (3, {"b": 1, "c": 2})


def test_appends_that_meet_keep_all_rows(spark, tmp_path):
    store, other = (ChunkStore(spark, str(tmp_path / "t")) for _ in range(2))
    store.append(chunks(spark, "x"))
    meanwhile(store, lambda: other.append(chunks(spark, "b")))
    store.append(chunks(spark, "a"))
    assert names(other) == ["a", "b", "x"]


@pytest.mark.parametrize("collection", ["c", "d"])
def test_rewrites_that_meet_lose_nothing(spark, tmp_path, collection):
    store, other = (ChunkStore(spark, str(tmp_path / "t")) for _ in range(2))
    store.append(chunks(spark, "x", "y"))
    meanwhile(store, lambda: other.append(chunks(spark, "b", collection=collection)))
    assert store.delete_document("x") == 2 and names(other) == ["b", "y"]
    meanwhile(store, lambda: other.delete_document("b"))
    assert store.overwrite(chunks(spark, "y", n=3)) == 3 and names(other) == ["y"] and other.count() == 3
    meanwhile(store, lambda: other.append(chunks(spark, "late")))
    assert store.compact()["compacted"] and names(other) == ["late", "y"]


def marks(rows):
    return rows.groupBy(F.concat(F.lit("/"), "document_name").alias("path"), "collection", "document_name").agg(
        F.count(F.lit(1)).cast("int").alias("chunks_committed"), F.lit(True).alias("complete")
    )


def test_a_batch_that_is_run_again_commits_once(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "t"))
    rows = chunks(spark, "a", "b")
    assert store.append_batch(rows, "s", 0, watermarks=marks(rows)) and not store.append_batch(rows, "s", 0, watermarks=marks(rows))
    assert store.count() == 4 and store.append_batch(rows, "other", 0, replace=False) and store.count() == 8
    assert sorted(map(tuple, store.watermarks().collect())) == [("/a", "c", "a", 2, True), ("/b", "c", "b", 2, True)]
    again = chunks(spark, "a", n=3)
    assert store.append_batch(again, "s", 1, watermarks=marks(again)) and store.count() == 7
    assert dict((r["path"], r["chunks_committed"]) for r in store.watermarks().collect()) == {"/a": 3, "/b": 2}
    assert ChunkStore(spark, store.root).prune() > 0 and store.count() == 7 and store.watermarks().count() == 2


def test_a_batch_that_is_lost_before_its_commit_leaves_nothing(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "t"))
    store.append(chunks(spark, "old"))
    commit = store._snapshots.commit
    store._snapshots.commit = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.append_batch(chunks(spark, "a"), "s", 0, watermarks=marks(chunks(spark, "a")))
    assert names(ChunkStore(spark, store.root)) == ["old"] and store.watermarks().count() == 0
    store._snapshots.commit = commit
    assert store.append_batch(chunks(spark, "a"), "s", 0, watermarks=marks(chunks(spark, "a"))) and names(store) == ["a", "old"]


def test_a_stream_of_files_is_flushed_in_bounded_parts(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "t")
    source.mkdir()
    schema = "document_name string, collection string, path string, text string"
    for k in range(3):
        spark.createDataFrame([(f"d{k}{j}", "c", f"/d{k}{j}", "word " * 100) for j in range(6)], schema).coalesce(1).write.mode("append").parquet(str(source))
    made = []

    def ingest(batch):
        rows = batch.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("page_number", F.lit(1))
        return rows.select("path", "collection", "document_name", "chunk_index", "page_number", "text")

    class Watched(ChunkStore):
        def append_batch(self, rows, stream, batch, part=0, **more):
            if len(made) == 2 and not made.count("lost"):
                made.append("lost")
                raise OSError("lost")
            done = super().append_batch(rows, stream, batch, part, **more)
            made.append((batch, part, done))
            return done

    def run(store):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(source))
        sink = chunk_sink(store, "files", ingest, flush_bytes=2500, admit=lambda b: b.where("document_name <> 'd00'"))
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost"):
        run(Watched(spark, root)).awaitTermination()
    run(Watched(spark, root)).awaitTermination()
    store = ChunkStore(spark, root)
    assert store.count() == 34 and len(names(store)) == 17
    assert store.watermarks().where("complete AND chunks_committed = 2").count() == 17
    tries = [m for m in made if m != "lost"]
    assert len({m[:2] for m in tries if m[2]}) > 3 and [m for m in tries if not m[2]] and CHUNKS
