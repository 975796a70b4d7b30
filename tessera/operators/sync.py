"""Incremental sync: what a listing of files changes in the table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.store import without_documents
from tessera.schema import migrate
from tessera.sources.listing import deletions_safe

INGEST, REFRESH, UNCHANGED, DELETE = "ingest", "refresh", "unchanged", "delete"
#: What stands for the hash of a file that can't be read.
UNKNOWN_HASH = "unknown"


def plan(listing: DataFrame, files: DataFrame, deletions_safe: bool = True) -> DataFrame:
    """One full outer join on path and an ``action`` for each.

    ``listing`` has path, mtime, size, content_hash, status ('ok', 'vanished', 'unreadable'); ``files`` is the registry.
    A file without a row, or partly ingested, is ingested; equal time and size is unchanged, whatever the hash; without
    a stored or new hash, or at another size, it is ingested; an equal hash is a refresh. A vanished file is deleted, an
    unreadable one kept as it is. Without a reliable listing nothing is deleted.
    """
    on_disk = listing.select("path", F.col("mtime").alias("new_mtime"), F.col("size").alias("new_size"), F.col("content_hash").alias("new_hash"), F.col("status"))
    both = on_disk.join(files, "path", "full")
    missing = F.col("status").isNull() | (F.col("status") == "vanished")
    action = (
        F.when(missing & F.col("collection").isNull(), None)
        .when(missing, F.lit(DELETE) if deletions_safe else F.lit(None))
        .when(F.col("collection").isNull() | F.col("partial_hash").isNotNull(), INGEST)
        .when((F.col("mtime") == F.col("new_mtime")) & (F.col("size") == F.col("new_size")), UNCHANGED)
        .when(F.col("status") == "unreadable", INGEST)
        .when(F.col("content_hash").isNull() | F.col("new_hash").isNull() | (F.col("size") != F.col("new_size")), INGEST)
        .when(F.col("content_hash") == F.col("new_hash"), REFRESH)
        .otherwise(INGEST)
    )
    return both.withColumn("action", action).where(F.col("action").isNotNull())


def without_unsure_deletes(planned: DataFrame, incomplete: DataFrame, root: str) -> DataFrame:
    """The plan without deletes under folders of ``root`` that a listing couldn't read (``incomplete``); others stay."""
    deletes = deletions_safe(planned.where(F.col("action") == DELETE), incomplete, root)
    return planned.where(F.col("action") != DELETE).unionByName(deletes)


def totals(planned: DataFrame, failed: bool = False) -> DataFrame:
    """Files by action, in one row; ``failed`` too of a plan that was carried out."""
    named = [(INGEST, "ingested"), (REFRESH, "refreshed"), (DELETE, "deleted"), (UNCHANGED, "skipped"), *([("failed", "failed")] if failed else [])]
    return planned.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in named])


def refreshed(planned: DataFrame, files: DataFrame, now: str) -> DataFrame:
    """The registry with new time and size of files whose content is the same."""
    rows = planned.where(F.col("action") == REFRESH)
    rows = rows.withColumns({"mtime": F.col("new_mtime"), "size": F.col("new_size"), "content_hash": F.col("new_hash"), "ingested_at": F.lit(now)})
    return files.join(rows.select("path"), "path", "left_anti").unionByName(rows.select(*files.columns))


def deleted_documents(planned: DataFrame) -> DataFrame:
    """(collection, document_name) of deleted files, each once."""
    return planned.where(F.col("action") == DELETE).select("collection", "document_name").distinct()


class Synced(NamedTuple):
    """What a sync leaves: the chunk table, the registry, the files that failed (path, error) and totals in one row."""

    chunks: DataFrame
    files: DataFrame
    failures: DataFrame
    totals: DataFrame


def execute(planned: DataFrame, files: DataFrame, chunks: DataFrame, read: DataFrame, fresh: DataFrame, now: str) -> Synced:
    """A plan carried out: deletes, then refreshes, then ingests, in which a file that fails leaves the others alone.

    ``read`` has a row for each file to ingest that was tried: path, collection, document_name, error (null if it was
    read whole); ``fresh`` has the chunks of those. A file of the plan without such a row failed. A document that was read
    takes the place of its old chunks and is whole in the registry. The old chunks of one that failed stay only if the
    committed part is of the current content (Y7); otherwise they and its row go, so that the next plan starts it again.

    All four results come from ``planned`` and ``read``: write both before, so that neither the join nor the reading is
    done more than once. Rows meet on path or on (collection, document_name); only ``fresh`` has texts, and is read once.
    """
    outcome = read.select("path", F.col("collection").alias("_collection"), F.col("document_name").alias("_name"), "error", F.lit(True).alias("_tried"))
    tried = planned.where(F.col("action") == INGEST).join(outcome, "path", "left")
    tried = tried.withColumn("error", F.when(F.col("_tried"), F.col("error")).otherwise("not read"))
    whole = tried.where(F.col("error").isNull())
    failed = tried.where(F.col("error").isNotNull())
    dropped = failed.where(F.col("collection").isNotNull() & clear_stale(F.col("partial_hash"), F.col("chunks_committed"), F.col("new_hash")))

    documents = whole.select(F.col("_collection").alias("collection"), F.col("_name").alias("document_name"))
    added = migrate(fresh).join(documents.distinct(), ["collection", "document_name"], "left_semi")
    gone = deleted_documents(planned).unionByName(dropped.select("collection", "document_name")).unionByName(documents).distinct()

    counts = added.groupBy(F.col("collection").alias("_collection"), F.col("document_name").alias("_name")).agg(F.count(F.lit(1)).cast("int").alias("_chunks"))
    rows = whole.join(counts, ["_collection", "_name"], "left").select(
        "path", F.col("_collection").alias("collection"), F.col("_name").alias("document_name"), F.col("new_mtime").alias("mtime"), F.col("new_size").alias("size"),
        F.lit(now).alias("ingested_at"), F.col("new_hash").alias("content_hash"), F.coalesce("_chunks", F.lit(0)).alias("chunks_committed"),
        F.lit(None).cast("string").alias("partial_hash"),
    )
    left = planned.where(F.col("action") == DELETE).select("path").unionByName(dropped.select("path")).unionByName(whole.select("path"))
    after = refreshed(planned, files, now).join(left, "path", "left_anti").unionByName(rows.select(*files.columns))
    return Synced(
        without_documents(chunks, gone).unionByName(added.select(*chunks.columns)),
        after,
        failed.select("path", "error"),
        run_totals(planned, read),
    )


def run_totals(planned: DataFrame, read: DataFrame) -> DataFrame:
    """A11 of a sync that was carried out: what was ingested in truth, and what failed."""
    done = planned.join(read.select("path", F.col("error").isNull().alias("_done")), "path", "left")
    failed = (F.col("action") == INGEST) & ~F.coalesce("_done", F.lit(False))
    return totals(done.withColumn("action", F.when(failed, "failed").otherwise(F.col("action"))), failed=True)


def one_file(planned: DataFrame, path: str) -> DataFrame:
    """The plan of a single changed file, for the same ``execute``: empty if its chunks are settled."""
    return planned.where((F.col("path") == path) & F.col("action").isin(INGEST, REFRESH))


def by_path(rows: DataFrame, folder: str, buckets: int = 64) -> None:
    """``rows`` (a registry or a listing) stored for ``plan_one``: partitioned by a hash of the path, sorted by it."""
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    told = rows.withColumn("bucket", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", "path")
    told.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def plan_one(listing: DataFrame, files: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """``plan`` of one path, of a listing and a registry that ``by_path`` stored: both scans read the path's bucket alone,
    in it the row groups that may hold the path, before anything is joined.
    """
    bucket = F.pmod(F.xxhash64(F.lit(path)), F.lit(buckets)).cast("int")
    at = listing.sparkSession.range(1).select(bucket.alias("b")).first()["b"]
    near = [rows.where((F.col("bucket") == at) & (F.col("path") == path)).drop("bucket") for rows in (listing, files)]
    return one_file(plan(*near), path)


def sweep_finalizes(scans: DataFrame) -> DataFrame:
    """Of scans (database, collection, seq), one finalize for each database, carried by its first collection."""
    return scans.groupBy("database").agg(F.min_by("collection", F.struct("seq", "collection")).alias("collection"), F.count(F.lit(1)).alias("scans"))


def stale_documents(catalog: DataFrame, listing: DataFrame, files: DataFrame, collection: str) -> DataFrame:
    """On re-adoption (no registry row for the collection), documents of absolute path that the listing lacks."""
    mine = catalog.where((F.col("collection") == collection) & F.col("document_path").startswith("/"))
    blank = files.where(F.col("collection") == collection).limit(1)
    return mine.join(blank.select(F.col("collection").alias("_c")), F.col("collection") == F.col("_c"), "left_anti").join(
        listing.where(F.col("status") != "vanished").select(F.col("path").alias("document_path")), "document_path", "left_anti"
    )


def resume_from(committed: Column, total: Column, partial_hash: Column, current_hash: Column, deterministic: Column) -> Column:
    """The chunk to go on from; 0 starts again."""
    holds = partial_hash.isNotNull() & (committed > 0) & (committed < total) & (partial_hash != UNKNOWN_HASH) & (partial_hash == current_hash) & deterministic
    return F.when(holds, committed).otherwise(F.lit(0))


def partial_mark(complete: Column, content_hash: Column) -> Column:
    """Null for a whole document, else the hash, or that it is unknown."""
    return F.when(complete, F.lit(None)).otherwise(F.coalesce(content_hash, F.lit(UNKNOWN_HASH)))


def clear_stale(partial_hash: Column, committed: Column, current_hash: Column) -> Column:
    """After a failure, whether old chunks must go: unless the committed part is of the current content."""
    return ~F.coalesce((committed > 0) & (partial_hash == current_hash), F.lit(False))


def reconcile(watermark: Column) -> Column:
    """What the store does before a document's chunks come: drop its tail, or all of it."""
    return F.when(watermark > 0, F.lit("tail")).otherwise(F.lit("document"))
