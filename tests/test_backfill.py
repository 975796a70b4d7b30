"""Transcript files in, chunks, capture files and totals out; front matter; the sink's commit and abort."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import transcripts
from tessera.operators.store import ChunkStore
from tessera.sources.backfill import backfill, read_transcripts
from tessera.sources.text_files import TextFilesWriter, write_text_files


def line(role, text):
    return json.dumps({"type": role, "message": {"role": role, "content": text}})


@pytest.fixture
def root(tmp_path):
    files = {
        "-home-a/11111111-one.jsonl": [line("user", "Fix it, mail me at joe@example.com."), "no json", line("assistant", "Done in commit abcdef1 on PR #12."), line("tool", "x")],
        "-home-a/22222222-two.jsonl": [],
        "-home-a/33333333-three.jsonl": [line("user", "known")],
        "-home-b/44444444-four.jsonl": [line("user", f"turn {k}") for k in range(2000)],
        "-elsewhere/55555555-five.jsonl": [line("user", "unregistered")],
        "-home-a/notes.txt": ["none"],
    }
    for name, lines in files.items():
        path = tmp_path / "projects" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(lines))
    return str(tmp_path / "projects")


DIRECTORIES = [("/home/a", "a", "2026"), ("/home/b", "b", "2026")]


def test_backfill_from_files_to_files(spark, tmp_path, root):
    sessions = read_transcripts(spark, root).persist()
    lines = {r["session_id"]: r["n_lines"] for r in sessions.collect()}
    assert lines == {"11111111-one": 4, "22222222-two": 0, "33333333-three": 1, "44444444-four": 2000, "55555555-five": 1}
    four = sessions.where("folder = '-home-b'").first()["text"]
    assert four == "\n\n".join(f"[user] turn {k}" for k in range(2000))
    directories = spark.createDataFrame(DIRECTORIES, "directory string, collection string, registered_at string")
    known = spark.createDataFrame([("a-captures", "session-33333333")], "collection string, document_name string")
    done = backfill(sessions, directories, known, F.lit("2026-01-02 00:00:00"))
    outcomes = {r["session_id"][:1]: r["outcome"] for r in done.outcomes.collect()}
    assert outcomes == {"1": "ingested", "2": "skipped_empty", "3": "skipped_existing", "4": "ingested", "5": "skipped_unregistered"}
    assert tuple(done.totals.first()) == (2, 1, 1, 1)
    store = ChunkStore(spark, str(tmp_path / "store"))
    store.overwrite(done.chunks)
    again = store.overwrite(done.chunks)
    assert again == store.count() == done.chunks.count() and store.collections() == ["a-captures", "b-captures"]
    first = "\n".join(r["text"] for r in store.read("a-captures").orderBy("chunk_index").collect())
    assert first.startswith("## Session Artifacts\nCommits: abcdef1\nPRs: #12") and "joe@" not in first and "[user] Fix it" in first
    write_text_files(done.captures, str(tmp_path / "disk"))
    name = tmp_path / "disk" / "home" / "a" / "captures" / "session-11111111.md"
    text = name.read_text()
    assert text.startswith("---\nsession_id: 11111111-one\ntimestamp: ") and "prs:\n  - 12" in text and "joe@" not in text and "Fix it" in text
    assert not [f for f in os.listdir(tmp_path / "disk") if f.startswith("_staging")]
    assert backfill(sessions, directories, known, F.lit("2026-01-02 00:00:00"), limit=1).chunks.select("collection").distinct().count() == 1


def test_front_matter(spark):
    row = spark.createDataFrame([("commit abcdef1 and PR #7 on branch feat/x, bd show ab-1c2", "s1"), ("nothing", "s2"), ("commit abcdef1", "")], "t string, s string")
    made = row.select(transcripts.front_matter(transcripts.artifacts(F.col("t")), F.col("s"), F.lit("2026-01-01T00:00:00")).alias("f"))
    full, plain, none = (r["f"] for r in made.collect())
    assert full == '---\nsession_id: s1\ntimestamp: "2026-01-01T00:00:00"\ncommits:\n  - abcdef1\nprs:\n  - 7\nbranches:\n  - feat/x\nbeads:\n  - ab-1c2\n---'
    assert plain == '---\nsession_id: s2\ntimestamp: "2026-01-01T00:00:00"\n---' and none == ""


def test_sink_commits_all_or_nothing(spark, tmp_path):
    root = tmp_path / "out"
    root.mkdir()
    (root / "a").mkdir()
    (root / "a" / "x.md").write_text("old")
    rows = spark.createDataFrame([("a/x.md", "new"), ("b/c/y.md", "ü"), ("z.md", None)], "path string, content string").repartition(3)
    write_text_files(rows, str(root))
    assert (root / "a" / "x.md").read_text() == "new" and (root / "b" / "c" / "y.md").read_text() == "ü" and not (root / "z.md").exists()
    bad = spark.createDataFrame([(f"f{k}.md", "x") for k in range(20)] + [("../up.md", "x")], "path string, content string").repartition(4)
    with pytest.raises(Exception, match="no path below the root"):
        write_text_files(bad, str(root))
    assert sorted(os.listdir(root)) == ["a", "b"] and not (tmp_path / "up.md").exists()
    writer = TextFilesWriter(str(root))
    lost = writer.write(iter([]))  # an attempt that doesn't count
    writer.write(iter([{"path": "late.md", "content": "x"}]))
    writer.commit([lost, None])
    assert sorted(os.listdir(root)) == ["a", "b"]


def test_transcripts_are_read_once(spark, root):
    plan = read_transcripts(spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [value" in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("budget", [0, 3, 5, 100])
def test_counted_texts_are_those_of_sessions(spark, budget):
    rows = [("a", 2, "xx"), ("a", 1, "yyy"), ("a", 3, None), ("b", 1, None), ("c", 1, "z" * 9), ("c", 2, None), ("d", 1, "")]
    entries = spark.createDataFrame(rows, "session string, at int, entry string")
    texts = {r["session"]: r["text"] for r in transcripts.session_texts(entries, "session", "at", budget=budget).collect()}
    found = {r["session"]: (r["n_lines"], r["text"]) for r in transcripts.counted_texts(entries, "session", "at", budget=budget).collect()}
    assert found == {s: (n, texts.get(s)) for s, n in (("a", 3), ("b", 1), ("c", 2), ("d", 1))}
