"""Which files of a directory belong to its collection: ignore rules as column predicates over a listing."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import HANDLERS, format_of

SUFFIXES = tuple(s for group in HANDLERS.values() for s in group)
#: Folders that hold what tools make.
SKIPPED = (
    ".tmp", ".git", ".hg", ".svn", ".beads", ".venv", "venv", "node_modules", "__pycache__", "dist", "build", "htmlcov", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".tox", ".nox", ".eggs", ".idea", ".vscode", "__MACOSX",
)
IGNORED = ("*.pyc", ".DS_Store")
#: Roots that are never document trees.
TEMPORARY = ("/tmp", "/private/tmp", "/var/tmp", "/var/folders", "/private/var/folders")


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """A line of an ignore file as a regular expression on a path relative to its folder, and whether it takes back; None
    for blank lines and comments. A pattern with a slash before its end is anchored; one that ends in a slash means folders.
    """
    text = line.rstrip("\n").rstrip()
    if not text or text.startswith("#"):
        return None
    back = text.startswith("!")
    text = text[back:].removeprefix("\\")
    folder = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    text = text.removeprefix("/")
    out, at = "", 0
    while at < len(text):
        if text.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif text.startswith("**", at):
            out, at = out + ".*", at + 2
        elif text[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif text[at] == "?":
            out, at = out + "[^/]", at + 1
        elif text[at] == "[" and (end := text.find("]", at + 2)) > 0:
            body = text[at + 1 : end]
            out, at = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, at = out + re.escape(text[at]), at + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), back


def ignored(relative: Column, lines: list[str]) -> Column:
    """Whether the last line that matches ignores the path; a line with '!' takes it back."""
    found = F.lit(False)
    for pattern in filter(None, map(ignore_pattern, lines)):
        found = F.when(relative.rlike(pattern[0]), F.lit(not pattern[1])).otherwise(found)
    return found


def is_deletable(relative: Column, suffixes: tuple[str, ...] = SUFFIXES, skipped: tuple[str, ...] = SKIPPED) -> Column:
    """By the name alone, since the file is gone: a known suffix, nothing hidden and no skipped folder on the way."""
    names = F.split(relative, "/")
    folders = F.slice(names, F.lit(1), F.size(names) - 1)
    hidden = F.exists(names, lambda n: n.startswith("."))
    made = F.exists(folders, lambda n: n.isin(*skipped) | n.endswith(".egg-info"))
    return format_of(relative).isin(*suffixes) & ~hidden & ~made


def is_indexable(relative: Column, lines: list[str], suffixes: tuple[str, ...] = SUFFIXES, skipped: tuple[str, ...] = SKIPPED) -> Column:
    """A file that a scan and a watch both take."""
    return is_deletable(relative, suffixes, skipped) & ~ignored(relative, [*IGNORED, *lines])


def refuses_root(root: str, temporary: tuple[str, ...] = TEMPORARY, exists: Callable[[str], bool] = lambda path: False) -> bool:
    """Temporary folders, whatever the case of their letters, and the '.tmp' of any repository that the root lies in,
    as ``exists`` tells of a '.git' beside it.
    """
    path = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/")
    folded = path.casefold()
    if any(folded == t or folded.startswith(t + "/") for t in temporary):
        return True
    parts = path.split("/")
    return any(parts[k] == ".tmp" and exists("/".join([*parts[:k], ".git"])) for k in range(1, len(parts)))


def discover(spark: SparkSession, root: str, ignore_files: tuple[str, ...] = (".gitignore",), suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, relative, modified, size) of the files under ``root`` that its rules let through, by path.

    A refused root has none. The root's ignore files are rules for all below; one in a nested folder rules that folder's
    direct children only. An unreadable folder fails the listing, so that no deletion is inferred from a part of it.
    """
    schema = "path string, relative string, modified timestamp, size long"
    if refuses_root(root, TEMPORARY, _exists(spark, root)):
        return spark.createDataFrame([], schema)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.split("://", 1)[-1].rstrip("/")), r"^file:", "")
    plain = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    rows = listed.select("path", F.substr(plain, F.length(base) + 2).alias("relative"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    folders = [r[0] for r in rows.select(F.regexp_extract("relative", r"^(.*/)?[^/]*$", 1)).distinct().collect()]  # names of folders alone
    found = ignore_rules(spark, root, [f for f in folders if not set(f.split("/")) & set(SKIPPED)], ignore_files)
    lines = [line for name in ignore_files for line in found.get(name, [])]
    kept = is_indexable(F.col("relative"), lines, suffixes)
    for relative, text in found.items():
        folder, slash, _ = relative.rpartition("/")
        if slash:
            below = F.col("relative").startswith(folder + "/")
            child = F.regexp_extract(F.substr(F.col("relative"), F.lit(len(folder) + 2)), r"^([^/]+/?)", 1)
            kept &= ~(below & ignored(F.when(child.endswith("/"), F.concat(child, F.lit("x"))).otherwise(child), text))
    return rows.where(kept).orderBy("path")


def _exists(spark: SparkSession, root: str) -> Callable[[str], bool]:
    """Whether a path of the file system that ``root`` is in exists."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    return lambda name: store.exists(path(name))


def ignore_rules(spark: SparkSession, root: str, folders: list[str], names: tuple[str, ...]) -> dict[str, list[str]]:
    """Lines of the ignore files of ``root`` and its ``folders`` (relative, with a slash at the end), by relative path.

    Spark's file sources hide names that begin with a dot, so these few files are read through Hadoop's file system.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for folder in sorted({"", *folders}):
        for name in names:
            path = spark._jvm.org.apache.hadoop.fs.Path(base, folder + name)
            if store.exists(path) and store.getFileStatus(path).isFile():
                stream = store.open(path)
                try:
                    found[folder + name] = bytes(stream.readAllBytes()).decode("utf-8", "replace").splitlines()
                finally:
                    stream.close()
    return found


def content_hash(content: Column) -> Column:
    """U4: a stable hash of a file's content."""
    return F.sha2(content, 256)
