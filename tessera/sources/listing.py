"""A directory tree listed level by level in tasks, with what of it couldn't be read."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scratch import scratch
from tessera.sources.discovery import IGNORED, SKIPPED, SUFFIXES, ignore_pattern, is_deletable

ENTRY = "relative string, folder string, is_folder boolean, size long, modified timestamp, inside boolean, rules array<struct<pattern:string,back:boolean>>, error string"


class Tree(NamedTuple):
    """files: (path, relative, modified, size), all that are there, links inside the root included; rules: (folder, patterns) of
    ignore files; incomplete: (folder, error) that couldn't be listed, '' being the root.
    """

    files: DataFrame
    rules: DataFrame
    incomplete: DataFrame


def _entries(root: str, folder: str, ignore_files: tuple[str, ...]) -> Iterator[tuple]:
    """What a folder holds, a folder below it without what that holds; a row with ``error`` if it can't be listed.

    Folders that are links aren't entered; a file that is a link counts as ``inside`` if what it leads to is.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    local = isinstance(store, fs.LocalFileSystem)
    real = os.path.realpath(base) if local else base
    place = f"{base}/{folder}" if folder else base
    try:
        if local and not os.access(place, os.R_OK | os.X_OK):
            raise PermissionError(f"no leave to list {place}")
        found = store.get_file_info(fs.FileSelector(place))
    except OSError as error:
        yield None, folder, True, None, None, False, None, str(error)
        return
    for info in sorted(found, key=lambda i: i.base_name):
        relative = f"{folder}/{info.base_name}" if folder else info.base_name
        is_folder, inside = info.type == fs.FileType.Directory, True
        if local and os.path.islink(f"{place}/{info.base_name}"):
            target = os.path.realpath(f"{place}/{info.base_name}")
            inside = os.path.isfile(target) and target.startswith(real + os.sep)
            if is_folder:
                continue
        rules = None
        if info.base_name in ignore_files and not is_folder:
            with store.open_input_stream(info.path) as stream:
                lines = stream.read().decode("utf-8", "replace").splitlines()
            rules = [{"pattern": p[0], "back": p[1]} for p in map(ignore_pattern, lines) if p]
        yield relative, folder, is_folder, None if is_folder else info.size, info.mtime, inside, rules, None


def list_tree(spark: SparkSession, root: str, ignore_files: tuple[str, ...] = (".gitignore",), skipped: tuple[str, ...] = SKIPPED, deepest: int = 200) -> Tree:
    """The tree below ``root``, folders of one level being listed by tasks of their own, so that no task and not the driver
    has the names of more than a folder. Hidden and ``skipped`` folders aren't entered.

    A folder that can't be listed doesn't fail the others: it is told, and deletions below it are not to be inferred
    (``deletions_safe``). Each level is written before the next is read.
    """
    base = root.rstrip("/")

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ENTRY.split(", ")]
        for frame in frames:
            for folder in frame["relative"]:
                rows = pd.DataFrame(_entries(base, folder, ignore_files), columns=columns)
                yield rows.assign(is_folder=rows["is_folder"].astype(bool), inside=rows["inside"].astype(bool), size=rows["size"].astype("Int64"))

    levels, frontier = [], spark.createDataFrame([("",)], "relative string")
    store = scratch(spark, "listing")
    for depth in range(deepest):
        path = f"{store}/level={depth}"
        frontier.mapInPandas(listed, ENTRY).write.parquet(path)
        level = spark.read.schema(ENTRY).parquet(path)
        levels.append(level)
        name = F.element_at(F.split("relative", "/"), -1)
        entered = level.where(F.col("is_folder") & F.col("error").isNull() & ~name.startswith(".") & ~name.isin(*skipped) & ~name.endswith(".egg-info"))
        frontier = entered.select("relative").repartition(max(1, min(4096, -(-entered.count() // 16))))
        if frontier.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, levels)
    files = rows.where(~F.col("is_folder") & F.col("inside") & F.col("error").isNull())
    plain = base.split("://", 1)[-1] if base.startswith("file://") else base
    files = files.select(F.concat(F.lit(plain + "/"), "relative").alias("path"), "relative", "modified", "size")
    rules = rows.where(F.col("rules").isNotNull()).select("folder", F.col("rules").alias("patterns"))
    return Tree(files, rules, rows.where(F.col("error").isNotNull()).select("folder", "error"))


def ancestors(relative: Column) -> Column:
    """The folders a path lies in, '' the first: ['', 'a', 'a/b'] of 'a/b/c'."""
    names = F.split(relative, "/")
    return F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))


def _matches(path: Column, patterns: Column) -> Column:
    """Whether the last pattern that matches ignores ``path``."""
    return F.aggregate(patterns, F.lit(False), lambda found, p: F.when(F.regexp_like(path, p["pattern"]), ~p["back"]).otherwise(found))


def admitted(tree: Tree, suffixes: tuple[str, ...] = SUFFIXES, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """The files that may come in: of a known suffix, nothing hidden, no skipped folder, and no rule against them.

    Rules of the root hold for all below; those of a nested folder for its direct children, which takes what is below an ignored
    folder along. A file meets the rules of the folders that it lies in by an equal join on folder.
    """
    known = tree.files.where(is_deletable(F.col("relative"), suffixes, skipped))
    general = [{"pattern": p[0], "back": p[1]} for p in map(ignore_pattern, IGNORED) if p]
    if general:
        always = F.array(*[F.struct(F.lit(g["pattern"]).alias("pattern"), F.lit(g["back"]).alias("back")) for g in general])
        known = known.where(~_matches(F.col("relative"), always))
    rest = F.substr(F.col("relative"), F.when(F.col("folder") == "", 1).otherwise(F.length("folder") + 2))
    child = F.regexp_extract(rest, r"^([^/]+/?)", 1)
    child = F.when(child.endswith("/"), F.concat(child, F.lit("x"))).otherwise(child)
    met = known.select("relative", F.explode(ancestors(F.col("relative"))).alias("folder")).join(tree.rules, "folder")
    asked = F.when(F.col("folder") == "", F.col("relative")).otherwise(child)
    refused = met.where(_matches(asked, F.col("patterns"))).select("relative").distinct()
    return known.join(refused, "relative", "left_anti").select("path", "relative", "modified", "size")


def deletions_safe(missing: DataFrame, incomplete: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Rows of ``missing`` (files of the registry that a listing of ``root`` lacks) that lie in no folder that couldn't be listed."""
    base = root.rstrip("/") + "/"
    relative = F.substr(F.col(path), F.lit(len(base) + 1))
    unsure = missing.where(F.col(path).startswith(base)).select(F.col(path).alias("_path"), F.explode(ancestors(relative)).alias("folder"))
    unsure = unsure.join(incomplete.select("folder"), "folder", "left_semi").select("_path").distinct()
    return missing.join(unsure, F.col(path) == F.col("_path"), "left_anti")
