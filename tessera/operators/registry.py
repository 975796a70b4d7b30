"""Registered directories, their markers, and what paths belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def under(path: Column, directory: Column) -> Column:
    """Whether ``path`` lies strictly below ``directory``, by whole names."""
    return path.startswith(F.concat(F.when(directory == "/", F.lit("")).otherwise(directory), F.lit("/"))) & (path != directory)


def ancestors(path: Column) -> Column:
    """All directories on the way to ``path``, itself included, from the root: a few strings, so that a nearest-ancestor
    join is an equi-join.
    """
    names = F.filter(F.split(path, "/"), lambda n: n != "")
    steps = F.transform(names, lambda n, i: F.concat(F.lit("/"), F.array_join(F.slice(names, F.lit(1), i + 1), "/")))
    return F.concat(F.array(F.lit("/")), steps)


def covering(cwds: DataFrame, directories: DataFrame, path_col: str = "cwd") -> DataFrame:
    """The nearest registered ancestor of each path, or null. Blank and relative paths have none."""
    given = cwds.withColumn("_path", F.when(F.col(path_col).startswith("/"), F.regexp_replace(path_col, "(?<=.)/+$", "")))
    steps = given.select(path_col, F.explode(ancestors(F.col("_path"))).alias("directory")).where(F.col("_path").isNotNull()).distinct()
    nearest = steps.join(directories, "directory").groupBy(path_col).agg(F.max_by(F.struct("directory", "collection"), F.length("directory")).alias("found"))
    return cwds.join(nearest, path_col, "left").select(*cwds.columns, F.col("found.directory").alias("directory"), F.col("found.collection").alias("collection"))


def captures_collection(cwds: DataFrame, directories: DataFrame, path_col: str = "cwd") -> DataFrame:
    """T20: '<collection>-captures' of the covering registration, else 'default-captures'."""
    name = F.concat(F.coalesce("collection", F.lit("default")), F.lit("-captures"))
    return covering(cwds, directories, path_col).withColumn("captures", name)


def subsumption(new: DataFrame, directories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new directories that lie under a registered one, registered ones that lie under a new one)."""
    above = new.select("directory", F.explode(ancestors(F.col("directory"))).alias("above")).where(F.col("above") != F.col("directory"))
    rejected = above.join(directories.select(F.col("directory").alias("above")), "above", "left_semi").select("directory").distinct()
    steps = directories.select("directory", "collection", F.explode(ancestors(F.col("directory"))).alias("above")).where(F.col("above") != F.col("directory"))
    evicted = steps.join(new.select(F.col("directory").alias("above")), "above", "left_semi").select("directory", "collection").distinct()
    return rejected, evicted


def under_directory(directories: DataFrame, parents: DataFrame) -> DataFrame:
    """Registrations strictly below any of ``parents`` (directory)."""
    steps = directories.withColumn("_above", F.explode(ancestors(F.col("directory")))).where(F.col("_above") != F.col("directory"))
    return steps.join(parents.select(F.col("directory").alias("_above")), "_above", "left_semi").select(*directories.columns).distinct()


def register(new: DataFrame, directories: DataFrame, retained: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M9: (directories afterwards, rejected with a reason, evicted collections to purge), of new (directory,
    collection, registered_at). Refused: a directory under a registered one, one that is or whose collection is
    registered, and a collection archived by another directory.
    """
    below, evicted = subsumption(new, directories)
    kept_names = retained.select("collection", "original_directory")
    known = directories.select("directory").withColumn("_same", F.lit(True))
    taken = directories.join(evicted.select("directory"), "directory", "left_anti").select("collection").withColumn("_taken", F.lit(True))
    judged = (
        new.join(below.withColumn("_below", F.lit(True)), "directory", "left")
        .join(known, "directory", "left")
        .join(taken, "collection", "left")
        .join(kept_names, "collection", "left")
        .withColumn(
            "reason",
            F.when(F.col("_below"), "under a registered directory")
            .when(F.col("_same"), "already registered")
            .when(F.col("_taken"), "collection in use")
            .when(F.col("original_directory").isNotNull() & (F.col("original_directory") != F.col("directory")), "collection archived by another directory"),
        )
    )
    accepted = judged.where(F.col("reason").isNull()).select(*new.columns)
    evicted = evicted.join(accepted.withColumn("_x", F.explode(F.array(F.lit(1)))).select(F.col("directory").alias("_new")), under(F.col("directory"), F.col("_new")), "left_semi")
    after = directories.join(evicted.select("directory"), "directory", "left_anti").unionByName(accepted.select(*directories.columns))
    return after, judged.where(F.col("reason").isNotNull()).select("directory", "collection", "reason"), evicted.select("collection")


def deregister(collection: str, directories: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(its sorted document names, directories without it, files without it)."""
    mine = F.col("collection") == collection
    return files.where(mine).select("document_name").distinct().orderBy("document_name"), directories.where(~mine), files.where(~mine)


def deregistered_markers(collection: str, directories: DataFrame, retained: DataFrame, pending: DataFrame, now: str, keep_data: bool = False) -> tuple[DataFrame, DataFrame]:
    """(retained, pending) after a deregistration: with ``keep_data`` the collection is retained for its directory and
    no longer pending, else it is pending. One that isn't registered gets no marker.
    """
    own = directories.where(F.col("collection") == collection)
    if not keep_data:
        return retained, marked(pending, own.select("collection", F.lit(now).alias("marked_at")))
    kept = own.select("collection", F.lit(now).alias("retained_at"), F.col("directory").alias("original_directory"))
    return marked(retained, kept), cleared(pending, own)


def marked(markers: DataFrame, marker: DataFrame) -> DataFrame:
    """Set markers, one for each collection."""
    return markers.join(marker.select("collection"), "collection", "left_anti").unionByName(marker)


def cleared(markers: DataFrame, collections: DataFrame) -> DataFrame:
    """Clear markers."""
    return markers.join(collections.select("collection"), "collection", "left_anti")


def purgeable(collections: DataFrame, pending: DataFrame, directories: DataFrame, retained: DataFrame, force: bool = False) -> DataFrame:
    """Collections that may be purged: pending, not registered, not retained; ``force`` asks for the last only."""
    free = collections.select("collection").distinct().join(retained.select("collection"), "collection", "left_anti")
    if force:
        return free
    return free.join(pending.select("collection"), "collection", "left_semi").join(directories.select("collection"), "collection", "left_anti")


def orphans(pending: DataFrame, chunk_collections: DataFrame, directories: DataFrame, retained: DataFrame) -> DataFrame:
    """(pending INTERSECT with chunks) EXCEPT registered EXCEPT retained."""
    name = lambda d: d.select("collection")
    return name(pending).intersect(name(chunk_collections)).subtract(name(directories)).subtract(name(retained))


def teardown(watched: DataFrame, current: DataFrame, complete: bool) -> DataFrame:
    """Watched collections no longer registered; none if the listing was not complete."""
    gone = watched.select("collection").subtract(current.select("collection"))
    return gone if complete else gone.limit(0)


def rescan(
    watched: DataFrame, current: DataFrame, complete: bool, pending: DataFrame, stored: DataFrame, directories: DataFrame, retained: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """What the safety pass removes: (watches to tear down, collections to purge); nothing if the listing of
    registrations was not complete.
    """
    purge = orphans(pending, stored, directories, retained)
    return teardown(watched, current, complete), purge if complete else purge.limit(0)


def archived_by_directory(directories: DataFrame, retained: DataFrame) -> DataFrame:
    """The first archived collection, by name, of each directory."""
    found = retained.where(F.col("original_directory").isNotNull()).groupBy(F.col("original_directory").alias("directory")).agg(F.min("collection").alias("archived"))
    return directories.select("directory").distinct().join(found, "directory")


def unlinked_captures(collections: DataFrame, directories: DataFrame, virtual: tuple[str, ...] = ("default-captures", "session-captures")) -> DataFrame:
    """J13, X5: '*-captures' collections, but for the virtual ones, whose name without the suffix isn't registered."""
    mine = collections.where(F.col("collection").endswith("-captures") & ~F.col("collection").isin(*virtual))
    named = mine.withColumn("_owner", F.regexp_replace("collection", "-captures$", ""))
    return named.join(directories.select(F.col("collection").alias("_owner")), "_owner", "left_anti").select("collection")


def named_collections(directories: DataFrame, taken: DataFrame) -> DataFrame:
    """A free collection name for each directory: its leaf, leaf-parent, leaf-<sha256 prefix>, or the whole digest
    and a count from 2, the first that is not taken. ``taken`` has collection.
    """
    names = F.filter(F.split("directory", "/"), lambda n: n != "")
    leaf = F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit("root"))
    parent = F.coalesce(F.try_element_at(names, F.lit(-2)), F.lit("root"))
    digest = F.sha2("directory", 256)
    prefixes = F.transform(F.sequence(F.lit(8), F.lit(64)), lambda n: F.concat(leaf, F.lit("-"), F.substr(digest, F.lit(1), n)))
    tried = directories.select("directory", F.posexplode(F.concat(F.array(leaf, F.concat(leaf, F.lit("-"), parent)), prefixes)).alias("place", "collection"))
    # Of n taken names stem-2, stem-3, ... one of the first n + 1 is free.
    stem = F.concat(leaf, F.lit("-"), digest)
    counted = taken.select(F.regexp_extract("collection", r"^(.*-[0-9a-f]{64})-\d+$", 1).alias("_stem")).where("_stem <> ''").groupBy("_stem").agg(F.count(F.lit(1)).alias("_n"))
    spare = directories.select("directory", stem.alias("_stem")).join(counted, "_stem", "left")
    steps = F.transform(F.sequence(F.lit(2).cast("long"), F.coalesce("_n", F.lit(0).cast("long")) + 2), lambda n: F.struct((n + 1000).cast("int").alias("place"), F.concat("_stem", F.lit("-"), n.cast("string")).alias("collection")))
    tried = tried.unionByName(spare.select("directory", F.inline(steps)))
    free = tried.join(taken.select("collection"), "collection", "left_anti")
    return free.groupBy("directory").agg(F.min_by("collection", "place").alias("collection"))


def path_collection(path: Column) -> Column:
    """The name of a file's directory."""
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


def url_collection(url: Column) -> Column:
    """The host of a URL, or 'default'."""
    return F.coalesce(F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("")), F.lit("default"))


def sync_recency(files: DataFrame, now: Column) -> DataFrame:
    """Newest ingest of each collection, the least age over them, and whether that is above a day; U3 as a phrase."""
    newest = files.groupBy("collection").agg(F.max(F.try_to_timestamp("ingested_at")).alias("newest"))
    hours = (F.unix_timestamp(now) - F.unix_timestamp(F.max("newest"))) / 3600
    aged = newest.agg(hours.alias("age_hours"))
    phrase = F.when(F.col("age_hours") >= 1, F.concat(F.floor("age_hours").cast("string"), F.lit("h ago"))).otherwise(
        F.concat(F.floor(F.col("age_hours") * 60).cast("string"), F.lit("m ago"))
    )
    return aged.select("age_hours", (F.col("age_hours") > 24).alias("stale"), phrase.alias("age"))
