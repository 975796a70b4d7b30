"""Listings by level: rules, links, folders that can't be read; plans of one path; URL columns."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.operators import sync
from tessera.schema import CHUNKS, FILES
from tessera.sources import listing


@pytest.fixture
def root(tmp_path):
    for name in ("a.md", "b.log.md", "sub/c.md", "sub/skip.md", "sub/deep/skip.md", "sub/off/x/y.md", "node_modules/x.md", ".hid/x.md", "e.exe", "out/z.md", "u v/ü.md", "empty.md"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text("" if name == "empty.md" else "x")
    (tmp_path / "r/.gitignore").write_text("# c\n*.log.md\nout/\n")
    (tmp_path / "r/sub/.gitignore").write_text("skip.md\noff/\n")
    (tmp_path / "elsewhere.md").write_text("secret")
    os.symlink(tmp_path / "elsewhere.md", tmp_path / "r/leak.md")
    os.symlink(tmp_path / "r/a.md", tmp_path / "r/sub/link.md")
    os.symlink(tmp_path / "r", tmp_path / "r/sub/loop")
    os.symlink(tmp_path / "gone.md", tmp_path / "r/dangling.md")
    return str(tmp_path / "r")


def test_tree_with_rules_and_links(spark, root):
    tree = listing.list_tree(spark, root)
    found = {r["relative"]: r["size"] for r in listing.admitted(tree).collect()}
    assert found == {"a.md": 1, "sub/c.md": 1, "sub/deep/skip.md": 1, "sub/link.md": 1, "u v/ü.md": 1, "empty.md": 0}
    assert tree.incomplete.count() == 0
    missing = listing.list_tree(spark, root + "/none")
    assert missing.files.count() == 0 and [r["folder"] for r in missing.incomplete.collect()] == [""]


def test_deletes_under_an_unread_folder_are_left(spark, root, monkeypatch):
    entries = listing._entries

    def broken(base, folder, ignore_files):
        if folder == "sub/deep":
            return iter([(None, folder, True, None, None, False, None, "no leave")])
        return entries(base, folder, ignore_files)

    tree = listing.list_tree(spark, root)
    incomplete = spark.createDataFrame([("sub/deep", "no leave")], "folder string, error string")
    names = ["sub/deep/skip.md", "sub/deep/a/b.md", "sub/gone.md", "sub/deeper.md"]
    rows = [(f"{root}/{n}", "c", n, 1.0, 1, "t", "h", 1, None) for n in names] + [("/else/where.md", "c", "w", 1.0, 1, "t", "h", 1, None)]
    files = spark.createDataFrame(rows, FILES)
    on_disk = tree.files.where("relative = 'none'").select("path", F.lit(1.0).alias("mtime"), "size", F.lit("h").alias("content_hash"), F.lit("ok").alias("status"))
    planned = sync.without_unsure_deletes(sync.plan(on_disk, files), incomplete, root)
    assert sorted(r["path"] for r in planned.collect()) == ["/else/where.md", f"{root}/sub/deeper.md", f"{root}/sub/gone.md"]
    assert sync.without_unsure_deletes(sync.plan(on_disk, files), incomplete.withColumn("folder", F.lit("")), root).count() == 1
    rows = list(broken(root, "sub/deep", ()))
    assert rows[0][-1] == "no leave" and len(list(broken(root, "sub", (".gitignore",)))) == 6
    if os.getuid() != 0:
        os.chmod(f"{root}/sub/deep", 0)
        assert [r["folder"] for r in listing.list_tree(spark, root).incomplete.collect()] == ["sub/deep"]


def test_plan_of_one_path_reads_its_bucket(spark, tmp_path):
    paths = [f"/w/f{k}.txt" for k in range(200)]
    files = spark.createDataFrame([(p, "c", p[3:], 1.0, 5, "t", "old", 2, None) for p in paths[:150]], FILES)
    disk = spark.createDataFrame([(p, 2.0, 5, "new" if k % 2 else "old", "ok") for k, p in enumerate(paths)], "path string, mtime double, size long, content_hash string, status string")
    for rows, name in ((files, "files"), (disk, "disk")):
        sync.by_path(rows, str(tmp_path / name), 16)
    stored = [spark.read.parquet(str(tmp_path / n)) for n in ("disk", "files")]
    whole = sync.plan(disk, files)
    for path in (paths[0], paths[1], paths[160], "/w/none"):
        assert sync.plan_one(*stored, path, 16).collect() == sync.one_file(whole, path).collect()
    plan = sync.plan_one(*stored, paths[1], 16)
    scans = [line for line in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert len(scans) == 2 and all("PartitionFilters: [isnotnull(bucket" in s and "EqualTo(path,/w/f1.txt)" in s for s in scans)
    read = spark.createDataFrame([(paths[1], "c", "f1.txt", None)], "path string, collection string, document_name string, error string")
    fresh = spark.createDataFrame([], CHUNKS).unionByName(spark.createDataFrame([("text", "f1.txt", "c", 0)], "text string, document_name string, collection string, chunk_index int"), allowMissingColumns=True)
    done = sync.execute(plan, files, spark.createDataFrame([], CHUNKS), read, fresh, "now")
    row = done.files.where(F.col("path") == paths[1]).first()
    assert (row["content_hash"], row["chunks_committed"], done.chunks.count(), done.files.count()) == ("new", 1, 1, 150)


def test_names_of_sitemaps_and_paths(spark):
    rows = spark.createDataFrame(
        [("https://a.b/sitemap.xml", True), ("https://a.b/x/Sitemap_1.XML.gz", True), ("https://a.b/sitemap", True), ("https://a.b/sitemaps/", False), ("https://a.b/mysitemap.xml", False), ("https://a.b/sitemap.txt?x=1", True)],
        "url string, is boolean",
    )
    assert rows.where(urls.is_sitemap(F.col("url")) != F.col("is")).count() == 0
    below = urls.path_include("/docs/")
    assert below == ["/docs", "/docs/*"] and urls.path_include("/") is None
    pages = spark.createDataFrame([("https://a.b/docs",), ("https://a.b/docs/x/y",), ("https://a.b/docsx",), ("https://a.b/",)], "url string")
    assert [r["url"] for r in pages.where(urls.passes(F.col("url"), below)).collect()] == ["https://a.b/docs", "https://a.b/docs/x/y"]
