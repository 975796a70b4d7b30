"""Queries of sync plans, registrations, table changes, sitemaps, transcripts and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.operators import evaluation, registry as reg, retrieval, sitemap, store, sync, transcripts
from tessera.operators.scratch import scratch
from tessera.plans.tables import (
    ARCHIVED,
    CHUNKS,
    DIRECTORIES,
    FILES,
    Registry,
    archived,
    chunk_rows,
    listed_files,
    registered_files,
    registrations,
    table,
)
from tessera.schema import migrate
from tessera.sources.backfill import Backfilled, backfill, read_transcripts
from tessera.sources.crawl import crawl, discovery_starts, fetched_from, ingest_urls
from tessera.sources.text_files import write_text_files

registry = Registry()
NOW = "2026-03-01T00:00:00+00:00"


# sync


@registry.add(f"{FILES} SELECT path, action FROM planned WHERE action IS NOT NULL")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, J3, Y1-Y3."""
    return sync.plan(listed_files(spark, sf_dir), registered_files(spark, sf_dir)).select("path", "action")


@registry.add(f"{FILES} SELECT path, action FROM planned WHERE action IS NOT NULL AND action <> 'delete'")
def sync_plan_unreliable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y2: an incomplete listing deletes nothing."""
    return sync.plan(listed_files(spark, sf_dir), registered_files(spark, sf_dir), deletions_safe=False).select("path", "action")


@registry.add(f"""{FILES} SELECT count(*) FILTER (WHERE action = 'ingest') AS ingested, count(*) FILTER (WHERE action = 'refresh') AS refreshed,
count(*) FILTER (WHERE action = 'delete') AS deleted, count(*) FILTER (WHERE action = 'unchanged') AS skipped FROM planned""")
def sync_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return sync.totals(sync.plan(listed_files(spark, sf_dir), registered_files(spark, sf_dir)))


@registry.add(f"{FILES} SELECT DISTINCT collection, document_name FROM planned WHERE action = 'delete'")
def sync_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, X2."""
    return sync.deleted_documents(sync.plan(listed_files(spark, sf_dir), registered_files(spark, sf_dir)))


@registry.add(f"""{FILES}, now_ AS (
    SELECT f.path, f.collection, f.document_name, CASE WHEN p.action = 'refresh' THEN p.new_mtime ELSE f.mtime END AS mtime,
           CASE WHEN p.action = 'refresh' THEN p.new_size ELSE f.size END AS size,
           CASE WHEN p.action = 'refresh' THEN '{NOW}' ELSE f.ingested_at END AS ingested_at,
           CASE WHEN p.action = 'refresh' THEN p.new_hash ELSE f.content_hash END AS content_hash, f.chunks_committed, f.partial_hash
    FROM files f LEFT JOIN planned p ON p.path = f.path)
SELECT * FROM now_""")
def sync_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11, M13."""
    files = registered_files(spark, sf_dir)
    return sync.refreshed(sync.plan(listed_files(spark, sf_dir), files), files, NOW)


def ran(spark: SparkSession, sf_dir: str) -> sync.Synced:
    """The plan carried out: each registered file has two chunks; of the files to ingest one of eleven can't be read and one
    of twenty-nine is never tried; the others have one chunk now.
    """
    at = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").withColumn("name", F.concat(F.lit("f"), at.cast("string"), F.lit(".txt")))
    kept = docs.where(at % 10 < 9).withColumn("chunk_index", F.explode(F.array(F.lit(0), F.lit(1))))
    chunks = migrate(kept.select("text", F.col("name").alias("document_name"), F.col("source").alias("collection"), "chunk_index"))
    planned = sync.plan(listed_files(spark, sf_dir), registered_files(spark, sf_dir))
    path = F.concat(F.lit("/w/"), "source", F.lit("/"), "name")
    read = docs.where(at % 29 != 0).select(
        path.alias("path"), F.col("source").alias("collection"), F.col("name").alias("document_name"), F.when(at % 11 == 0, "unreadable").alias("error")
    )
    fresh = docs.select(F.concat("text", F.lit("!")).alias("text"), F.col("name").alias("document_name"), F.col("source").alias("collection"), F.lit(0).alias("chunk_index"))
    return sync.execute(planned, registered_files(spark, sf_dir), chunks, read, fresh, NOW)


RAN = f"""{FILES}, tried AS (
    SELECT p.path, p.action, p.new_mtime, p.new_size, p.new_hash, f.partial_hash, f.chunks_committed, split_part(p.path, '/', 3) AS source,
           CAST(regexp_extract(p.path, 'f([0-9]+)[.]txt$', 1) AS BIGINT) AS id
    FROM planned p LEFT JOIN files f ON f.path = p.path WHERE p.action IS NOT NULL
), outcome AS (
    SELECT *, CASE WHEN action <> 'ingest' THEN action WHEN id % 29 = 0 OR id % 11 = 0 THEN 'failed' ELSE 'ingested' END AS done FROM tried
), stay AS (
    SELECT f.*, o.done, o.new_mtime, o.new_size, o.new_hash FROM files f LEFT JOIN outcome o ON o.path = f.path
    WHERE o.path IS NULL OR o.done IN ('refresh', 'unchanged') OR (o.done = 'failed' AND coalesce(o.chunks_committed > 0 AND o.partial_hash = o.new_hash, false))
)"""


@registry.add(f"""{RAN} SELECT s.collection, s.document_name, i.chunk_index, md5(d.text) AS text_md5
FROM stay s JOIN documents d ON 'f' || d.doc_id || '.txt' = s.document_name CROSS JOIN (VALUES (0), (1)) i(chunk_index)
UNION ALL SELECT o.source, 'f' || o.id || '.txt', 0, md5(d.text || '!') FROM outcome o JOIN documents d ON d.doc_id = o.id WHERE o.done = 'ingested'""")
def sync_run_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table after a sync in which some files fail."""
    return ran(spark, sf_dir).chunks.select("collection", "document_name", "chunk_index", F.md5("text").alias("text_md5"))


@registry.add(f"""{RAN} SELECT path, collection, CASE WHEN done = 'refresh' THEN new_mtime ELSE mtime END AS mtime, CASE WHEN done = 'refresh' THEN new_size ELSE size END AS size,
CASE WHEN done = 'refresh' THEN '{NOW}' ELSE ingested_at END AS ingested_at, CASE WHEN done = 'refresh' THEN new_hash ELSE content_hash END AS content_hash,
chunks_committed, partial_hash FROM stay
UNION ALL SELECT path, source, new_mtime, new_size, '{NOW}', new_hash, 1, NULL FROM outcome WHERE done = 'ingested'""")
def sync_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after it."""
    return ran(spark, sf_dir).files.drop("document_name")


@registry.add(f"{RAN} SELECT path, CASE WHEN id % 29 = 0 THEN 'not read' ELSE 'unreadable' END AS error FROM outcome WHERE done = 'failed'")
def sync_run_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each failure is its file's own."""
    return ran(spark, sf_dir).failures


@registry.add(f"""{RAN} SELECT count(*) FILTER (WHERE done = 'ingested') AS ingested, count(*) FILTER (WHERE done = 'refresh') AS refreshed,
count(*) FILTER (WHERE done = 'delete') AS deleted, count(*) FILTER (WHERE done = 'unchanged') AS skipped, count(*) FILTER (WHERE done = 'failed') AS failed FROM outcome""")
def sync_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 with failures."""
    return ran(spark, sf_dir).totals


@registry.add("""SELECT 'db' || (user_id % 3) AS database, arg_min('c' || (user_id % 7), event_id) AS collection, count(*) AS scans FROM events GROUP BY 1""")
def sweep_finalizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many scans, one finalize for each database."""
    name = lambda prefix, n: F.concat(F.lit(prefix), (F.col("user_id") % n).cast("string"))
    scans = table(spark, sf_dir, "events").select(name("db", 3).alias("database"), name("c", 7).alias("collection"), F.col("event_id").alias("seq"))
    return sync.sweep_finalizes(scans)


@registry.add(f"""{FILES} SELECT '/w/' || source || '/f' || doc_id || '.txt' AS document_path, 'f' || doc_id || '.txt' AS document_name
FROM documents d WHERE source = 'src1' AND NOT EXISTS (
    SELECT 1 FROM listing l WHERE l.status <> 'vanished' AND l.path = '/w/' || d.source || '/f' || d.doc_id || '.txt')""")
def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection that comes back without a registry."""
    names = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt"))
    known = table(spark, sf_dir, "documents").select(
        names.alias("document_name"), F.concat(F.lit("/w/"), "source", F.lit("/"), names).alias("document_path"), F.col("source").alias("collection")
    )
    files = registered_files(spark, sf_dir).where("collection <> 'src1'")
    return sync.stale_documents(known, listed_files(spark, sf_dir), files, "src1").select("document_path", "document_name")


@registry.add(f"""{FILES} SELECT f.path,
    CAST(CASE WHEN f.partial_hash IS NOT NULL AND chunks_committed > 0 AND chunks_committed < 2 AND f.partial_hash = l.content_hash AND l.size % 2 = 0
         THEN chunks_committed ELSE 0 END AS INTEGER) AS resume_at,
    CASE WHEN l.size % 2 = 0 THEN NULL ELSE l.content_hash END AS mark,
    NOT coalesce(chunks_committed > 0 AND f.partial_hash = l.content_hash, false) AS clear,
    CASE WHEN chunks_committed > 0 THEN 'tail' ELSE 'document' END AS step
FROM files f JOIN listing l ON l.path = f.path""")
def sync_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y5-Y7, Y10."""
    new = listed_files(spark, sf_dir).select("path", F.col("content_hash").alias("now"), (F.col("size") % 2 == 0).alias("even"))
    rows = registered_files(spark, sf_dir).join(new, "path")
    done, old, now, even = F.col("chunks_committed"), F.col("partial_hash"), F.col("now"), F.col("even")
    return rows.select(
        "path", sync.resume_from(done, F.lit(2), old, now, even).alias("resume_at"), sync.partial_mark(even, now).alias("mark"),
        sync.clear_stale(old, done, now).alias("clear"), sync.reconcile(done).alias("step"),
    )


# registrations


def working_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("doc_id")
    cwd = (
        F.when(at % 11 == 0, F.lit("")).when(at % 13 == 0, F.concat(F.lit("w/"), "source")).when(at % 5 == 0, F.concat(F.lit("/w/"), "source"))
        .when(at % 3 == 0, F.concat(F.lit("/w/"), "source", F.lit("x/a"))).otherwise(F.concat(F.lit("/w/"), "source", F.lit("/deep/"), (at % 4).cast("string")))
    )
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").select(at.alias("doc_id"), cwd.alias("cwd"))


CWDS = f"""{DIRECTORIES}, cwds AS (
    SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN 'w/' || source WHEN doc_id % 5 = 0 THEN '/w/' || source
           WHEN doc_id % 3 = 0 THEN '/w/' || source || 'x/a' ELSE '/w/' || source || '/deep/' || (doc_id % 4) END AS cwd
    FROM documents WHERE source IS NOT NULL
), found AS (
    SELECT doc_id, cwd, arg_max(d.directory, length(d.directory)) AS directory, arg_max(d.collection, length(d.directory)) AS collection
    FROM cwds LEFT JOIN directories d ON cwd = d.directory OR starts_with(cwd, d.directory || '/') GROUP BY doc_id, cwd
)"""


@registry.add(f"{CWDS} SELECT doc_id, cwd, directory, collection FROM found")
def covering_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest ancestor by an equi-join on the steps of the path."""
    return reg.covering(working_directories(spark, sf_dir), registrations(spark, sf_dir)).select("doc_id", "cwd", "directory", "collection")


@registry.add(f"{CWDS} SELECT doc_id, coalesce(collection, 'default') || '-captures' AS captures FROM found")
def captures_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T20."""
    return reg.captures_collection(working_directories(spark, sf_dir), registrations(spark, sf_dir)).select("doc_id", "captures")


def newcomers(spark: SparkSession) -> DataFrame:
    rows = [("/w/src1/deep/er", "n1"), ("/v", "n2"), ("/w/src2", "n3"), ("/u", "src5"), ("/t", "src4"), ("/s", "n4"), ("/w/src3", "old")]
    return spark.createDataFrame([(d, c, "2026-02-01") for d, c in rows], "directory string, collection string, registered_at string")


NEW = """, fresh(directory, collection) AS (
    VALUES ('/w/src1/deep/er', 'n1'), ('/v', 'n2'), ('/w/src2', 'n3'), ('/u', 'src5'), ('/t', 'src4'), ('/s', 'n4'), ('/w/src3', 'old')
), judged AS (
    SELECT f.*, CASE
        WHEN EXISTS (SELECT 1 FROM directories d WHERE starts_with(f.directory, d.directory || '/')) THEN 'under a registered directory'
        WHEN EXISTS (SELECT 1 FROM directories d WHERE d.directory = f.directory) THEN 'already registered'
        WHEN EXISTS (SELECT 1 FROM directories d WHERE d.collection = f.collection) THEN 'collection in use'
        WHEN EXISTS (SELECT 1 FROM retained r WHERE r.collection = f.collection AND r.original_directory <> f.directory) THEN 'collection archived by another directory'
        END AS reason FROM fresh f
)"""


@registry.add(f"{DIRECTORIES}{ARCHIVED}{NEW} SELECT directory, collection, reason FROM judged WHERE reason IS NOT NULL")
def register_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9, J10."""
    return reg.register(newcomers(spark), registrations(spark, sf_dir), archived(spark))[1]


@registry.add(f"""{DIRECTORIES}{ARCHIVED}{NEW} SELECT directory, collection FROM judged WHERE reason IS NULL
UNION ALL SELECT directory, collection FROM directories d WHERE NOT EXISTS (
    SELECT 1 FROM judged j WHERE reason IS NULL AND starts_with(d.directory, j.directory || '/'))""")
def register_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: registrations afterwards; those under a new one are evicted."""
    return reg.register(newcomers(spark), registrations(spark, sf_dir), archived(spark))[0].select("directory", "collection")


@registry.add(f"{FILES} SELECT DISTINCT document_name FROM files WHERE collection = 'src2'")
def deregister_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10."""
    return reg.deregister("src2", registrations(spark, sf_dir), registered_files(spark, sf_dir))[0]


def deregistered_marks(spark: SparkSession, sf_dir: str, collection: str, keep_data: bool) -> DataFrame:
    retained, waiting = reg.deregistered_markers(collection, registrations(spark, sf_dir), archived(spark), pending(spark), NOW, keep_data)
    return retained.select(F.lit("retained").alias("marker"), "collection", "original_directory").unionByName(
        waiting.select(F.lit("pending").alias("marker"), "collection", F.lit(None).cast("string").alias("original_directory"))
    )


@registry.add(f"""{DIRECTORIES}{ARCHIVED}, pending(collection) AS (VALUES ('src1'), ('src3'), ('src6'), ('gone'), ('lone2')),
own AS (SELECT * FROM directories WHERE collection = 'src1')
SELECT 'retained' AS marker, collection, original_directory FROM retained WHERE collection <> 'src1' UNION ALL SELECT 'retained', collection, directory FROM own
UNION ALL SELECT 'pending', collection, NULL FROM pending WHERE collection NOT IN (SELECT collection FROM own)""")
def deregister_keeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data kept: retained for its directory, no longer pending."""
    return deregistered_marks(spark, sf_dir, "src1", True)


@registry.add(f"""{DIRECTORIES}{ARCHIVED}, pending(collection) AS (VALUES ('src1'), ('src3'), ('src6'), ('gone'), ('lone2'))
SELECT 'retained' AS marker, collection, original_directory FROM retained
UNION ALL SELECT 'pending', collection, NULL FROM (SELECT collection FROM pending UNION SELECT collection FROM directories WHERE collection = 'src2')""")
def deregister_purging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data not kept: pending."""
    return deregistered_marks(spark, sf_dir, "src2", False)


@registry.add(f"{DIRECTORIES} SELECT directory, collection FROM directories WHERE starts_with(directory, '/w/src1/') OR starts_with(directory, '/v/')")
def under_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    parents = spark.createDataFrame([("/w/src1",), ("/v",)], "directory string")
    return reg.under_directory(registrations(spark, sf_dir), parents).select("directory", "collection")


def pending(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, "2026-01-01") for c in ("src1", "src3", "src6", "gone", "lone2")], "collection string, marked_at string")


def stored_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("collection"))


MARKS = ", pending(collection) AS (VALUES ('src1'), ('src3'), ('src6'), ('gone'), ('lone2'))"


@registry.add(f"""{DIRECTORIES}{ARCHIVED}{MARKS} SELECT DISTINCT source AS collection FROM documents WHERE source IN (SELECT collection FROM pending)
AND source NOT IN (SELECT collection FROM directories WHERE collection <> 'src6') AND source NOT IN (SELECT collection FROM retained)""")
def orphan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3, G9."""
    directories = registrations(spark, sf_dir).where("collection <> 'src6'")
    return reg.orphans(pending(spark), stored_collections(spark, sf_dir), directories, archived(spark))


@registry.add(f"""{DIRECTORIES}{ARCHIVED}{MARKS} SELECT DISTINCT source AS collection FROM documents WHERE source IN (SELECT collection FROM pending)
AND source NOT IN (SELECT collection FROM directories WHERE collection <> 'src1') AND source NOT IN (SELECT collection FROM retained)""")
def purgeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, M12."""
    directories = registrations(spark, sf_dir).where("collection <> 'src1'")
    return reg.purgeable(stored_collections(spark, sf_dir), pending(spark), directories, archived(spark))


@registry.add(f"{DIRECTORIES} SELECT DISTINCT source || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '-b' END AS collection FROM documents EXCEPT SELECT collection FROM directories")
def watch_teardown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4."""
    name = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "").otherwise("-b"))
    return reg.teardown(table(spark, sf_dir, "documents").select(name.alias("collection")), registrations(spark, sf_dir), complete=True)


@registry.add(f"""{DIRECTORIES}{ARCHIVED}, pending(collection) AS (VALUES ('src1'), ('src3'), ('src6'), ('gone'), ('lone2'))
SELECT 'watch' AS what, collection FROM (SELECT DISTINCT source || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '-b' END AS collection FROM documents EXCEPT SELECT collection FROM directories)
UNION ALL SELECT 'purge', collection FROM (SELECT 'gone' AS collection UNION SELECT DISTINCT source FROM documents)
WHERE collection IN (SELECT collection FROM pending) AND collection NOT IN (SELECT collection FROM directories) AND collection NOT IN (SELECT collection FROM retained)""")
def safety_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a complete pass removes."""
    odd = F.when(F.col("doc_id") % 2 == 0, "").otherwise("-b")
    watched = table(spark, sf_dir, "documents").select(F.concat("source", odd).alias("collection")).distinct()
    stored = stored_collections(spark, sf_dir).union(spark.createDataFrame([("gone",)], "collection string"))
    current = registrations(spark, sf_dir)
    gone, purge = reg.rescan(watched, current, True, pending(spark), stored, current, archived(spark))
    return gone.select(F.lit("watch").alias("what"), "collection").unionByName(purge.select(F.lit("purge").alias("what"), "collection"))


@registry.add(f"""{DIRECTORIES}{ARCHIVED} SELECT d.directory, min(r.collection) AS archived FROM directories d JOIN retained r ON r.original_directory = d.directory
GROUP BY d.directory""")
def archived_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12."""
    return reg.archived_by_directory(registrations(spark, sf_dir), archived(spark))


@registry.add(f"""{DIRECTORIES} SELECT collection FROM (VALUES ('src1-captures'), ('nowhere-captures'), ('default-captures'), ('src2')) v(collection)
WHERE collection LIKE '%-captures' AND collection NOT IN ('default-captures', 'session-captures')
AND regexp_replace(collection, '-captures$', '') NOT IN (SELECT collection FROM directories)""")
def unlinked_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, X5."""
    names = spark.createDataFrame([(c,) for c in ("src1-captures", "nowhere-captures", "default-captures", "src2")], "collection string")
    return reg.unlinked_captures(names, registrations(spark, sf_dir))


@registry.add(f"""{DIRECTORIES} SELECT DISTINCT '/n/' || source AS directory,
CASE WHEN source = 'src1' THEN 'src1-' || substr(sha256('/n/src1'), 1, 8) ELSE source || '-n' END AS collection FROM documents WHERE source IS NOT NULL""")
def collection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf names are taken by registrations, one leaf-parent too."""
    taken = registrations(spark, sf_dir).select("collection").union(spark.createDataFrame([("src1-n",)], "collection string")).distinct()
    dirs = stored_collections(spark, sf_dir).distinct().select(F.concat(F.lit("/n/"), "collection").alias("directory"))
    return reg.named_collections(dirs, taken)


@registry.add(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host_collection, coalesce(nullif(
regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([^/]+)/[^/]*$', 1), ''), '') AS path_collection FROM pages""")
def derived_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T21, U6, U12."""
    url = F.col("url")
    path = reg.path_collection(urls.part(url, "PATH"))
    return table(spark, sf_dir, "pages").select("page_id", reg.url_collection(url).alias("host_collection"), F.coalesce(path, F.lit("")).alias("path_collection"))


@registry.add("""WITH newest AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)
SELECT round((epoch_us(TIMESTAMP '2024-02-15 00:00:00') // 1000000 - epoch_us(max(ts)) // 1000000) / 3600.0, 6) AS age_hours,
       (epoch_us(TIMESTAMP '2024-02-15 00:00:00') // 1000000 - epoch_us(max(ts)) // 1000000) / 3600.0 > 24 AS stale FROM newest""")
def sync_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, U2, U3."""
    files = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("collection"), F.col("ts").cast("string").alias("ingested_at"))
    return reg.sync_recency(files, F.lit("2024-02-15 00:00:00").cast("timestamp")).select(F.round("age_hours", 6).alias("age_hours"), "stale")


# table changes


@registry.add(f"{CHUNKS} SELECT collection, document_name, chunk_index FROM chunks WHERE NOT (collection = 'src1' AND document_name IN (SELECT 'doc-' || (doc_id // 5) FROM documents WHERE doc_id % 2 = 0))")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 for many documents."""
    rows = chunk_rows(spark, sf_dir)
    name = F.concat(F.lit("doc-"), F.floor(F.col("doc_id") / 5).cast("string"))
    gone = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.lit("src1").alias("collection"), name.alias("document_name")).distinct()
    return store.without_documents(rows, gone).select("collection", "document_name", "chunk_index")


@registry.add(f"{CHUNKS} SELECT collection, document_name, chunk_index FROM chunks WHERE NOT (CAST(substr(document_name, 5) AS BIGINT) % 2 = 0 AND chunk_index >= 2)")
def delete_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 for many documents."""
    rows = chunk_rows(spark, sf_dir)
    marks = rows.where(F.substring("document_name", 5, 99).cast("long") % 2 == 0).select("collection", "document_name", F.lit(2).alias("watermark")).distinct()
    return store.without_tails(rows, marks).select("collection", "document_name", "chunk_index")


@registry.add(f"""{CHUNKS}, fresh AS (SELECT * FROM chunks WHERE chunk_index = 1)
SELECT collection, document_name, chunk_index, 'old' AS age FROM chunks c WHERE NOT EXISTS (
    SELECT 1 FROM fresh f WHERE f.collection = c.collection AND f.document_name = c.document_name)
UNION ALL SELECT collection, document_name, chunk_index, 'new' FROM fresh""")
def overwrite_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: only documents with a new chunk are replaced."""
    rows = chunk_rows(spark, sf_dir).withColumn("age", F.lit("old"))
    fresh = rows.where("chunk_index = 1").withColumn("age", F.lit("new"))
    return store.overwritten(rows, fresh).select("collection", "document_name", "chunk_index", "age")


@registry.add(f"{CHUNKS} SELECT document_name, chunk_index, '' AS agent_handle, '' AS memory_type, '' AS summary FROM chunks")
def migrated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: rows of an older table."""
    old = chunk_rows(spark, sf_dir).drop("agent_handle", "memory_type", "summary")
    return migrate(old).select("document_name", "chunk_index", "agent_handle", "memory_type", "summary")


# sitemaps


def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("page_id")
    changed = F.when(at % 5 != 0, F.timestamp_seconds(F.lit(1767225600) + at * 3600))
    return table(spark, sf_dir, "pages").select(F.col("url").alias("loc"), at.alias("at"), changed.alias("lastmod"))


@registry.add("""SELECT url AS loc, coalesce(page_id % 2 = 0 AND page_id % 5 <> 0 AND page_id * 3600 <= 360000, false) AS skip FROM (
    SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)""")
def sitemap_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that the catalog has and that did not change since."""
    found = sitemap.first_by_url(sitemap_entries(spark, sf_dir), "loc", ["at"])
    known = found.where("at % 2 = 0").select(F.col("loc").alias("document_name"), F.lit("web").alias("collection"), F.lit("2026-01-05 04:00:00").alias("ingestion_timestamp"))
    return sitemap.freshness(found, known, "web").select("loc", "skip")


@registry.add(r"""WITH paths AS (SELECT url, page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, url AS loc FROM paths WHERE (path GLOB '/en/*' OR path GLOB '/fr/*') AND NOT path GLOB '*7*' ORDER BY page_id LIMIT 60""")
def sitemap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first safe entries that the globs let through."""
    found = sitemap_entries(spark, sf_dir)
    return sitemap.select_safe(found, ["at"], ["/en/*", "/fr/*"], ["*7*"], 60).select(F.col("at").alias("page_id"), "loc")


@registry.add(r"SELECT page_id, regexp_extract(url, '^[^?#]+') AS bare FROM pages")
def bare_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17."""
    from tessera.functions.redact import Redaction

    plain = Redaction(secrets=False, personal=False, profanity=False)
    return table(spark, sf_dir, "pages").select("page_id", urls.bare_url(F.col("url"), plain).alias("bare"))


@registry.add("""SELECT 'd' || doc_id AS loc, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE TIMESTAMP '2026-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) END AS lastmod
FROM documents""")
def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed sitemap documents, one for each source, every location twice."""
    at = F.col("doc_id")
    when = F.when(at % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("<lastmod>"), F.date_format(F.timestamp_seconds(F.lit(1767225600) + at * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</lastmod>")))
    node = F.concat(F.lit("<url><loc>d"), at.cast("string"), F.lit("</loc>"), when, F.lit("</url>"))
    part = F.floor(at / 50)
    rows = table(spark, sf_dir, "documents").groupBy(part.alias("order")).agg(F.array_join(F.sort_array(F.collect_list(node)), "").alias("nodes"))
    whole = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "nodes", "nodes", F.lit("</urlset>"))
    return sitemap.entries(rows.select(F.concat(F.lit("s"), F.col("order").cast("string")).alias("url"), whole.alias("xml"), "order")).select("loc", "lastmod")


def stored_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of one host (url, html) with its robots.txt, an index of indexes that also names itself, and sitemaps of forty pages
    each, the last pages of one being the first of the next.
    """
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://site.test/p"), F.col("page_id").cast("string")).alias("url"), "html", F.col("page_id").alias("at"))
    part, over = F.floor(F.col("at") / 40), F.when((F.col("at") % 40 < 3) & (F.col("at") >= 40), F.floor(F.col("at") / 40) - 1)
    listed = pages.select("url", "at", F.explode(F.array_compact(F.array(part, over))).alias("part"))
    nodes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "url"))), lambda n: F.concat(F.lit("<url><loc>"), n["url"], F.lit("</loc></url>"))), "")
    wrapped = lambda kind, inner: F.concat(F.lit(f"<{kind} xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">"), inner, F.lit(f"</{kind}>"))
    place = lambda name, n: F.concat(F.lit(f"https://site.test/{name}"), n.cast("string"), F.lit(".xml"))
    maps = listed.groupBy("part").agg(nodes.alias("nodes")).select(place("map", F.col("part")).alias("url"), wrapped("urlset", F.col("nodes")).alias("html"), "part")
    named = lambda url: F.concat(F.lit("<sitemap><loc>"), url, F.lit("</loc></sitemap>"))
    many = lambda rows: F.array_join(F.transform(F.sort_array(rows), lambda r: named(r["url"])), "")
    groups = maps.groupBy(F.floor(F.col("part") / 5).alias("group")).agg(many(F.collect_list(F.struct("part", "url"))).alias("nodes"))
    groups = groups.select(place("group", F.col("group")).alias("url"), wrapped("sitemapindex", F.concat("nodes", named(F.lit("https://site.test/index.xml")))).alias("html"), "group")
    index = groups.agg(many(F.collect_list(F.struct("group", "url"))).alias("nodes"))
    index = index.select(F.lit("https://site.test/index.xml").alias("url"), wrapped("sitemapindex", F.concat(named(F.lit("https://site.test/gone.xml")), "nodes")).alias("html"))
    robots = spark.createDataFrame([("https://site.test/robots.txt", "User-agent: *\nSitemap: https://site.test/index.xml\n")], "url string, html string")
    return reduce(DataFrame.unionByName, [rows.select("url", "html") for rows in (pages, maps, groups, index, robots)])


@registry.add("""WITH p AS (SELECT page_id, page_id // 40 - CASE WHEN page_id % 40 < 3 AND page_id >= 40 THEN 1 ELSE 0 END AS part FROM pages)
SELECT 'https://site.test/p' || page_id AS loc, CAST(part // 5 AS BIGINT) AS grp, CAST(part % 5 AS BIGINT) AS map FROM p""")
def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a site found from its robots.txt through three levels of sitemaps with a cycle; where each is first listed."""
    start = discovery_starts(spark.createDataFrame([("https://site.test/somewhere",)], "url string"))
    found = crawl(start, fetched_from(stored_site(spark, sf_dir)))
    # A place is that of robots.txt, of the index in it, of the group in the index behind one that is gone, and of the map in the group.
    return found.select("loc", (F.col("place")[2] - 1).alias("grp"), F.col("place")[3].alias("map"))


@registry.add("""WITH p AS (SELECT page_id, 'https://site.test/p' || page_id AS loc FROM pages)
SELECT loc, page_id % 3 <> 0 AS kept, page_id % 4 = 0 AS skip FROM p""")
def ingested_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each page of a stored site whose catalog has every fourth."""
    web = stored_site(spark, sf_dir)
    at = F.expr("try_cast(regexp_extract(loc, 'p([0-9]+)$', 1) AS BIGINT)")
    found = crawl(discovery_starts(spark.createDataFrame([("https://site.test/",)], "url string")), fetched_from(web))
    pages = found.withColumn("lastmod", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    known = found.where(at % 4 == 0).select(F.col("loc").alias("document_name"), F.lit("web").alias("collection"), F.lit("2026-02-01 00:00:00").alias("ingestion_timestamp"))
    rows = sitemap.freshness(pages, known, "web").select("loc", (at % 3 != 0).alias("kept"), "skip")
    site = ingest_urls(rows, fetched_from(web), F.lit("2026-03-01 00:00:00"))
    return site.outcomes.where("error IS NULL").select("loc", "kept", "skip")


# transcripts


def transcript_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", transcripts.message_text(record).alias("entry"))


ENTRIES = r"""WITH entries AS (
    SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') AND length(trim(text)) > 0 THEN '[' || role || '] ' || text END AS entry FROM conversations
)"""


@registry.add(f"{ENTRIES} SELECT conv_id, turn, entry FROM entries WHERE entry IS NOT NULL")
def transcript_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S20, T13, U8."""
    return transcript_entries(spark, sf_dir).where("entry IS NOT NULL")


@registry.add(f"""{ENTRIES}, summed AS (
    SELECT *, sum(length(entry)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM entries WHERE entry IS NOT NULL)
SELECT conv_id, string_agg(entry, chr(10) || chr(10) ORDER BY turn) AS text FROM summed WHERE s <= 3000 GROUP BY conv_id""")
def transcript_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, T13, with a budget of 3,000 characters."""
    return transcripts.session_texts(transcript_entries(spark, sf_dir), "conv_id", "turn", budget=3000)


@registry.add("""SELECT doc_id, printf('%07x', doc_id) || 'a' AS commits, CAST(doc_id % 1000 AS VARCHAR) AS prs, 'feat/x' || doc_id AS branches FROM documents""")
def session_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, pull requests and branches, each named twice."""
    at = F.col("doc_id")
    sha = F.concat(F.lower(F.lpad(F.hex(at), 7, "0")), F.lit("a"))
    pr, branch = (at % 1000).cast("string"), F.concat(F.lit("feat/x"), at.cast("string"))
    text = F.concat_ws(" ", F.lit("commit"), sha, F.lit("then commit"), sha, F.concat(F.lit("PR #"), pr), F.concat(F.lit("pr/"), pr), F.lit("git checkout -b"), branch)
    found = transcripts.artifacts(text)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(found["commit_shas"], ",").alias("commits"), F.array_join(found["pr_numbers"].cast("array<string>"), ",").alias("prs"),
        F.array_join(found["branch_names"], ",").alias("branches"),
    )


@registry.add()
def conversation_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14, W7 over the whole texts of all turns. Tested by cases."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", transcripts.artifacts(F.col("text")).alias("found")).select(
        "conv_id", "turn", "role", "found.*"
    )


@registry.add(f"""{DIRECTORIES}, t AS (
    SELECT d.doc_id, d.text, x.collection || '-captures' AS collection FROM documents d
    LEFT JOIN directories x ON replace(x.directory, '/', '-') = '-w-' || CASE WHEN d.doc_id % 4 = 0 THEN 'none' ELSE d.source END)
SELECT count(*) FILTER (WHERE collection IS NOT NULL AND doc_id % 3 <> 0 AND doc_id % 5 <> 0) AS ingested,
       count(*) FILTER (WHERE collection IS NOT NULL AND doc_id % 3 = 0) AS skipped_existing,
       count(*) FILTER (WHERE collection IS NULL) AS skipped_unregistered,
       count(*) FILTER (WHERE collection IS NOT NULL AND doc_id % 3 <> 0 AND doc_id % 5 = 0) AS skipped_empty FROM t""")
def backfill_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, J8, S21, Y12, A12."""
    return transcripts.backfill_totals(planned_backfill(spark, sf_dir))


def planned_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    folder = F.concat(F.lit("-w-"), F.when(at % 4 == 0, "none").otherwise(F.col("source")))
    session = F.lpad(at.cast("string"), 8, "0")
    given = docs.select(folder.alias("folder"), session.alias("session_id"), F.when(at % 5 == 0, " ").otherwise(F.concat(F.lit("x "), "text")).alias("text"))
    there = docs.where(at % 3 == 0).select(F.concat("source", F.lit("-captures")).alias("collection"), transcripts.document_of_session(session).alias("document_name"))
    return transcripts.backfill_plan(given, registrations(spark, sf_dir), there)


@registry.add(f"""{DIRECTORIES}, t AS (
    SELECT d.doc_id, '-w-' || CASE WHEN d.doc_id % 4 = 0 THEN 'none' ELSE d.source END AS folder, lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS session_id FROM documents d
), o AS (
    SELECT t.*, CASE WHEN x.collection IS NULL THEN 'skipped_unregistered' WHEN doc_id % 3 = 0 THEN 'skipped_existing'
                     WHEN doc_id % 5 = 0 THEN 'skipped_empty' ELSE 'ingested' END AS outcome
    FROM t LEFT JOIN directories x ON replace(x.directory, '/', '-') = t.folder
), v AS (
    SELECT *, count(*) FILTER (WHERE outcome IN ('ingested', 'skipped_empty')) OVER (ORDER BY folder, session_id ROWS UNBOUNDED PRECEDING)
              - CASE WHEN outcome IN ('ingested', 'skipped_empty') THEN 1 ELSE 0 END AS before FROM o)
SELECT count(*) FILTER (WHERE outcome = 'ingested' AND doc_id % 31 <> 0) AS ingested, count(*) FILTER (WHERE outcome = 'skipped_existing') AS skipped_existing,
       count(*) FILTER (WHERE outcome = 'skipped_unregistered') AS skipped_unregistered, count(*) FILTER (WHERE outcome = 'skipped_empty') AS skipped_empty,
       count(*) FILTER (WHERE outcome = 'ingested' AND doc_id % 31 = 0) AS errors FROM v WHERE outcome = 'skipped_unregistered' OR before < 20""")
def backfill_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty transcripts are processed, some fail."""
    planned = planned_backfill(spark, sf_dir)
    errors = planned.where(F.col("session_id").cast("long") % 31 == 0)
    return transcripts.backfill_totals(transcripts.backfill_run(planned, 20, errors), errors=True)


def conversation_files(spark: SparkSession, sf_dir: str) -> str:
    """Every conversation as a transcript file in the folder of one of six directories, the last not registered."""
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    lines = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    folder = F.concat(F.lit("-w-src"), (F.col("conv_id") % 6).cast("string"))
    path = F.concat(folder, F.lit("/"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("-x.jsonl"))
    root = scratch(spark, "transcripts")
    write_text_files(lines.select(path.alias("path"), F.concat(F.array_join("lines.line", "\n"), F.lit("\nno json\n")).alias("content")), root)
    return root


@registry.add(f"""{ENTRIES}, {DIRECTORIES.strip().removeprefix("WITH ")}, lines AS (
    SELECT conv_id, count(*) + 1 AS n_lines, coalesce(string_agg(entry, chr(10) || chr(10) ORDER BY turn), '') AS text FROM entries GROUP BY conv_id
)
SELECT '-w-src' || (conv_id % 6) AS folder, lpad(CAST(conv_id AS VARCHAR), 8, '0') || '-x' AS session_id, n_lines,
       CASE WHEN x.collection IS NULL THEN 'skipped_unregistered' WHEN conv_id % 3 = 0 THEN 'skipped_existing' WHEN text = '' THEN 'skipped_empty' ELSE 'ingested' END AS outcome,
       CASE WHEN x.collection IS NOT NULL THEN 'session-' || lpad(CAST(conv_id AS VARCHAR), 8, '0') END AS document_name
FROM lines LEFT JOIN directories x ON replace(x.directory, '/', '-') = '-w-src' || (conv_id % 6)""")
def backfill_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as transcript files by the sink, read again, and what becomes of each."""
    found = backfilled(spark, sf_dir).outcomes
    return found.select("folder", "session_id", "n_lines", "outcome", F.when(F.col("outcome") != "skipped_unregistered", F.col("document_name")).alias("document_name"))


def backfilled(spark: SparkSession, sf_dir: str) -> Backfilled:
    sessions = read_transcripts(spark, conversation_files(spark, sf_dir))
    given = scratch(spark, "sessions")
    sessions.write.parquet(given)
    session = F.lpad(F.col("conv_id").cast("string"), 8, "0")
    there = table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select("conv_id").distinct()
    there = there.select(F.concat(F.lit("src"), F.col("conv_id") % 6, F.lit("-captures")).alias("collection"), transcripts.document_of_session(session).alias("document_name"))
    return backfill(spark.read.parquet(given), registrations(spark, sf_dir), there, F.lit("2026-03-01 00:00:00"))


@registry.add()
def backfill_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that a backfill of all conversations puts in. Tested against its parts."""
    return backfilled(spark, sf_dir).chunks.select("collection", "document_name", "page_number", "chunk_index", "text")


@registry.add("""WITH a AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, 'p' || event_id DESC) AS n FROM events)
SELECT 'p' || event_id AS path FROM a WHERE n > 1 OR epoch_us(TIMESTAMP '2024-04-10 00:00:00') // 1000000 - epoch_us(ts) // 1000000 > 90 * 86400""")
def archives_to_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S26, W5."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_prefix"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("modified")
    )
    return transcripts.archives_to_delete(rows, F.lit("2024-04-10 00:00:00").cast("timestamp")).select("path")


# evaluation


def ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hits: 40 queries, each of as many positions as there are documents for it."""
    at = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        (at % 40).alias("query_id"), F.concat(F.lit("doc "), (F.floor(at / 3) % 7).cast("string")).alias("document_name"),
        (at % 3).cast("int").alias("page_number"), F.floor(at / 40).cast("int").alias("position"), "text",
    )


RUN = """WITH run AS (
    SELECT doc_id % 40 AS query_id, 'doc_' || (doc_id // 3 % 7) || CASE WHEN doc_id % 3 > 0 THEN '#p' || (doc_id % 3) ELSE '#doc' END AS docid,
           CAST(min(doc_id // 40) AS INTEGER) AS position FROM documents GROUP BY ALL
)"""


@registry.add(f"{RUN} SELECT query_id, docid, position, 1.0::DOUBLE / (position + 1) AS score FROM run")
def collapsed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, T18."""
    return evaluation.collapse(ranked_hits(spark, sf_dir), page_level=True)


@registry.add(f"{RUN} SELECT query_id, docid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY position, docid) AS INTEGER) AS rank FROM run")
def trec_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    return evaluation.trec_rank(evaluation.collapse(ranked_hits(spark, sf_dir), page_level=True)).select("query_id", "docid", "rank")


@registry.add(f"""{RUN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position, docid) AS rank FROM run
), queries AS (
    SELECT item_id AS query_id, ['natural', 'known-item', 'regression'][item_id % 3 + 1] AS bucket,
           CASE WHEN item_id % 4 <> 3 THEN 'doc_' || (item_id % 8) || CASE WHEN item_id % 3 > 0 THEN '#p' || (item_id % 3) ELSE '#doc' END END AS answer FROM benchmark
), per AS (
    SELECT q.query_id, q.bucket, q.answer, min(CASE WHEN r.docid = q.answer THEN r.rank END) AS first,
           coalesce(avg(CASE WHEN r.rank <= 10 THEN CASE WHEN r.docid = q.answer THEN 1.0 ELSE 0.0 END END), 0) AS judged
    FROM queries q LEFT JOIN ranked r USING (query_id) GROUP BY ALL
), told AS (
    SELECT bucket, answer, CASE WHEN answer IS NOT NULL THEN coalesce(1.0 / first, 0) END AS rr,
           CASE WHEN answer IS NOT NULL THEN coalesce(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END, 0) END AS h5,
           CASE WHEN answer IS NOT NULL THEN coalesce(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END, 0) END AS h10,
           CASE WHEN answer IS NOT NULL THEN judged END AS judged FROM per
)
SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n_queries, count(answer) AS n_scorable, CAST(round(avg(rr), 9) AS DOUBLE) AS mrr,
       CAST(round(avg(h5), 9) AS DOUBLE) AS success_at_5, CAST(round(avg(h10), 9) AS DOUBLE) AS success_at_10,
       CAST(round(avg(judged), 9) AS DOUBLE) AS judged_at_10 FROM told GROUP BY ROLLUP (bucket)""")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, J14."""
    at = F.col("item_id")
    answer = F.when(at % 4 != 3, F.struct(F.concat(F.lit("doc "), (at % 8).cast("string")).alias("document_name"), (at % 3).cast("int").alias("page_number")))
    bucket = F.when(at % 3 == 0, "natural").when(at % 3 == 1, "known-item").otherwise("regression")
    queries = table(spark, sf_dir, "benchmark").select(at.alias("query_id"), bucket.alias("bucket"), answer.alias("answer"))
    run = evaluation.collapse(ranked_hits(spark, sf_dir), page_level=True)
    return evaluation.metrics(queries, run, evaluation.qrels_of(queries)).drop("pollution_at_10")


@registry.add("""SELECT doc_id % 40 AS query_id, avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS pollution
FROM documents WHERE doc_id // 40 < 10 GROUP BY ALL""")
def pollution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every third text is made a changelog, a contents list or front matter in turn; the others are prose."""
    at = F.col("doc_id")
    made = F.when(at % 9 == 0, F.lit("## [1.2.0]\n- x")).when(at % 9 == 3, F.lit("# Table of Contents\n")).when(at % 9 == 6, F.lit("---\na: b\n---\n"))
    prose = F.lit("one two three four five six seven eight nine ten eleven twelve thirteen words in one line")
    rows = table(spark, sf_dir, "documents").select((at % 40).alias("query_id"), F.floor(at / 40).cast("int").alias("position"), F.coalesce(made, prose).alias("text"))
    return evaluation.pollution(rows)


@registry.add()
def document_pollution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 over the whole texts of the hits. Tested by cases."""
    return evaluation.pollution(ranked_hits(spark, sf_dir))


@registry.add("""SELECT substr(sha256(string_agg(CAST(item_id AS VARCHAR) || chr(0) || sha256(text), chr(10) ORDER BY CAST(item_id AS VARCHAR))), 1, 16) AS signature
FROM benchmark""")
def corpus_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return evaluation.corpus_signature(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("content")))


@registry.add("""WITH r AS (SELECT doc_id, doc_id % 40 AS query_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) - 1 AS rank FROM documents)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 5""")
def channel_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each query."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("query_id"), "doc_id")
    return retrieval._top_per_query(rows, [F.col("doc_id")], 5)
