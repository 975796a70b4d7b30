"""The chunk table as copy-on-write snapshots of Parquet, partitioned by collection."""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import document_selector, postings
from tessera.operators.snapshots import Snapshots
from tessera.schema import CHUNKS, migrate


#: Columns of a watermark: how far a document has got in the table.
WATERMARKS = "path, collection, document_name, chunks_committed, complete, batch, part"


class _Changed(Exception):
    """A collection was written meanwhile."""


def _whole(state: dict[str, Any]) -> dict[str, Any]:
    """A snapshot with all its parts; older ones are the folders by collection alone."""
    if not isinstance(state.get("batches"), dict):
        state = {"collections": state}
    return {"collections": {}, "batches": {}, "watermarks": []} | state


def _added(folders: dict[str, list[str]], added: dict[str, str]) -> dict[str, list[str]]:
    return {c: folders.get(c, []) + ([added[c]] if c in added else []) for c in {*folders, *added}}


class ChunkStore:
    """S1-S3, M1-M8. A snapshot is a small JSON file that lists data folders by collection; a write adds folders and then
    the snapshot that follows the one it read, so readers see all of a change or nothing. Every data folder holds whole
    collections or appended rows of them; a delete or overwrite rewrites only the collections that it touches.

    Files go through Hadoop's file system, so any store that Spark writes to will do. Of writers that meet, the first commits;
    another adds its change to the newer snapshot, and does its rewrite again if a collection that it rewrote has changed.
    A snapshot also has the last batch of each stream that was put in (``append_batch``) and folders of watermarks.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._snapshots = Snapshots(spark, self.root)
        self._fs = self._snapshots.fs

    # snapshots

    def _hadoop(self, path: str):
        return self._snapshots.path(path)

    def versions(self) -> list[int]:
        return self._snapshots.versions()

    def _state(self, version: int | None = None) -> dict[str, Any]:
        known = [version] if version else self.versions()
        return _whole(self._snapshots.read(known[-1])) if known else _whole({})

    def _folders(self, version: int | None = None) -> dict[str, list[str]]:
        return self._state(version)["collections"]

    def _update(self, change: Callable[[dict[str, Any]], dict[str, Any] | None]) -> int:
        return self._snapshots.update(lambda state: change(_whole(state)), {})[0]

    def _replace(self, seen: dict[str, list[str]], made: dict[str, list[str]]) -> bool:
        """Put ``made`` in place of the collections ``seen``, unless another writer has changed one of them since."""

        def change(state: dict[str, Any]) -> dict[str, Any]:
            now = state["collections"]
            if any(now.get(c, []) != paths for c, paths in seen.items()):
                raise _Changed
            kept = {c: p for c, p in now.items() if c not in seen} | made
            return state | {"collections": {c: p for c, p in kept.items() if p}}

        try:
            self._update(change)
        except _Changed:
            return False
        return True

    # reads

    def collections(self) -> list[str]:
        return sorted(self._folders())

    def read(self, collection: str | None = None, version: int | None = None) -> DataFrame:
        """The table, or one collection of it, whose folders alone are then read (M7). Empty before the first write."""
        folders = self._folders(version)
        chosen = folders if collection is None else {collection: folders.get(collection, [])}
        paths = [p for found in chosen.values() for p in found]
        if not paths:
            return self.spark.createDataFrame([], CHUNKS)
        return migrate(self.spark.read.schema(CHUNKS).parquet(*paths))

    def count(self, collection: str | None = None) -> int:
        return self.read(collection).count()

    def file_count(self) -> int:
        """A14."""
        return len(self.read().inputFiles()) if any(self._folders().values()) else 0

    # writes

    def _write(self, rows: DataFrame, files: int | None = None, spread: int = 1) -> dict[str, str]:
        """New folders by collection; a folder of another name for each, so nothing that is read is overwritten. With
        ``files`` the rows are dealt to so many tasks, those of a collection to ``spread`` of them.
        """
        base = f"{self.root}/data-{uuid.uuid4().hex}"
        named = migrate(rows).withColumn("_of", F.col("collection"))
        salt = F.pmod(F.xxhash64("document_name", "page_number", "chunk_index"), F.lit(spread))
        (named.repartition(files, "_of", salt) if files else named).write.partitionBy("_of").parquet(base)
        path = self._hadoop(base)
        found = [s.getPath().toString() for s in self._fs.listStatus(path) if s.getPath().getName().startswith("_of=")]
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {unescape(p.rsplit("/_of=", 1)[1]): p for p in found}

    def append(self, rows: DataFrame) -> int:
        """S3: add rows as they are (twice gives duplicates); the number added."""
        rows = migrate(rows)
        if rows.isEmpty():
            return 0
        added = self._write(rows)
        self._update(lambda state: state | {"collections": _added(state["collections"], added)})
        return self.spark.read.schema(CHUNKS).parquet(*added.values()).count()

    def append_batch(self, rows: DataFrame, stream: str, batch: int, part: int = 0, watermarks: DataFrame | None = None, replace: bool = True) -> bool:
        """Part ``part`` of batch ``batch`` of ``stream``, once however often it is run; whether it was new.

        Rows and ``watermarks`` (path, collection, document_name, chunks_committed, complete) are written first, and one
        snapshot shows both and the batch's number: a writer lost before it leaves nothing but folders that nobody lists,
        and one that comes again after it changes nothing. With ``replace`` the documents of ``rows`` give way to them.
        """
        place = [batch, part]
        while True:
            seen = self._state()
            if seen["batches"].get(stream, [-1, -1]) >= place:
                return False
            new = migrate(rows)
            touched = [r["collection"] for r in new.select("collection").distinct().collect()]
            old = {c: seen["collections"].get(c, []) for c in touched} if replace else {}
            made = self._write(self._with(new, old)) if touched else {}
            marks = []
            if watermarks is not None:
                marks = [f"{self.root}/marks-{uuid.uuid4().hex}"]
                watermarks.withColumn("batch", F.lit(batch)).withColumn("part", F.lit(part)).select(*WATERMARKS.split(", ")).write.parquet(marks[0])

            def change(state: dict[str, Any]) -> dict[str, Any] | None:
                if state["batches"].get(stream, [-1, -1]) >= place:
                    return None
                if any(state["collections"].get(c, []) != paths for c, paths in old.items()):
                    raise _Changed
                now = {c: p for c, p in state["collections"].items() if c not in old}
                return {"collections": _added(now, made), "batches": state["batches"] | {stream: place}, "watermarks": state["watermarks"] + marks}

            try:
                self._update(change)
                return True
            except _Changed:
                continue

    def watermarks(self) -> DataFrame:
        """How many chunks of each path are in the table, and whether that is all: the last mark of each."""
        folders = self._state()["watermarks"]
        schema = "path string, collection string, document_name string, chunks_committed int, complete boolean, batch long, part int"
        if not folders:
            return self.spark.createDataFrame([], schema).drop("batch", "part")
        rows = self.spark.read.schema(schema).parquet(*folders)
        last = rows.groupBy("path").agg(F.max_by(F.struct("collection", "document_name", "chunks_committed", "complete"), F.struct("batch", "part")).alias("m"))
        return last.select("path", "m.*")

    def _with(self, new: DataFrame, old: dict[str, list[str]]) -> DataFrame:
        """``new`` and what the folders ``old`` have of other documents."""
        paths = [p for found in old.values() for p in found]
        if not paths:
            return new
        fresh = new.select("collection", "document_name").distinct()
        return migrate(self.spark.read.schema(CHUNKS).parquet(*paths)).join(fresh, ["collection", "document_name"], "left_anti").unionByName(new)

    def _rewrite(self, gone: Column, touched: list[str]) -> int:
        """Drop the rows of ``touched`` that ``gone`` holds for; how many."""
        while True:
            before = self._folders()
            seen = {c: before[c] for c in touched if before.get(c)}
            if not seen:
                return 0
            rows = migrate(self.spark.read.schema(CHUNKS).parquet(*[p for paths in seen.values() for p in paths]))
            n = rows.where(gone).count()
            if not n:
                return 0
            made = self._write(rows.where(~F.coalesce(gone, F.lit(False))))
            if self._replace(seen, {c: [p] for c, p in made.items()}):
                return n

    def delete_document(self, document_name: str, collection: str | None = None) -> int:
        """M1, A15."""
        return self._rewrite(document_selector(document_name), [collection] if collection else self.collections())

    def delete_tail(self, document_name: str, collection: str, watermark: int) -> int:
        """M2: chunks from ``watermark`` on; 0 is an error, since that is a delete of the document."""
        if watermark <= 0:
            raise ValueError("the watermark of a tail must be positive")
        return self._rewrite(document_selector(document_name, from_chunk=watermark), [collection])

    def delete_collection(self, collection: str) -> int:
        """M3: only the snapshot changes."""
        while True:
            paths = self._folders().get(collection)
            if not paths:
                return 0
            n = self.spark.read.schema(CHUNKS).parquet(*paths).count()
            if self._replace({collection: paths}, {}):
                return n

    def overwrite(self, rows: DataFrame) -> int:
        """M4: put ``rows`` in place of the documents that they have at least one chunk of, in one snapshot."""
        new = migrate(rows)
        while True:
            before = self._folders()
            seen = {r["collection"]: before.get(r["collection"], []) for r in new.select("collection").distinct().collect()}
            if not seen:
                return 0
            made = self._write(self._with(new, seen))
            if self._replace(seen, {c: [p] for c, p in made.items()}):
                return new.count()

    def compact(self, files_per_collection: int = 1, most_files: int = 10_000, force: bool = False) -> dict[str, object]:
        """M6: rewrite every collection in at most ``files_per_collection`` files, each written by a task of its own. Above ``most_files`` files it is skipped unless forced."""
        files = self.file_count()
        if files > most_files and not force:
            return {"compacted": False, "reason": f"{files} files are more than {most_files}"}
        while files:
            seen = self._folders()
            rows = migrate(self.spark.read.schema(CHUNKS).parquet(*[p for paths in seen.values() for p in paths]))
            spread = max(1, files_per_collection)
            made = self._write(rows, 4 * spread * max(1, len(seen)), spread)
            if self._replace(seen, {c: [p] for c, p in made.items()}):
                break
        return {"compacted": True, "files_before": files, "files_after": self.file_count()}

    def prune(self, keep: int = 1, older_than: float = 0.0) -> int:
        """Remove all but the last ``keep`` snapshots and those replaced less than ``older_than`` seconds ago, and the data
        that none of them has; how many folders and snapshots. Without an age call it when no reader is on them.
        """
        known = self.versions()
        since = time.time() - older_than
        changed = lambda path: self._fs.getFileStatus(self._hadoop(path)).getModificationTime() / 1000
        written = lambda v: changed(self._snapshots.file(v))
        replaced = dict(zip(known, known[1:]))
        kept = [v for n, v in enumerate(known) if n >= len(known) - keep or (older_than and v in replaced and written(replaced[v]) > since)]
        used = {p.split("/_of=")[0].rsplit("/", 1)[1] for v in kept for paths in self._folders(v).values() for p in paths}
        used |= {p.rsplit("/", 1)[1] for v in kept for p in self._state(v)["watermarks"]}
        names = self._snapshots.names()
        gone = [self._snapshots.file(v) for v in known if v not in kept]
        # A folder that no snapshot lists may be of a writer at work, so with an age only old ones go.
        loose = [f"{self.root}/{n}" for n in names if n.startswith(("data-", "marks-")) and n not in used]
        gone += [path for path in loose if not older_than or changed(path) <= since]
        claims = [self._snapshots.claim(v) for v in known if v not in kept]
        for path in gone + claims:
            self._fs.delete(self._hadoop(path), True)
        return len(gone)

    def finalize(self, index: str, publish: Callable[[DataFrame], None] | None = None, older_than: float = 3600.0) -> dict[str, object]:
        """M8, M6: after a sync: compact, store the postings of the whole table under a new folder of ``index`` in ranges
        of terms, publish, prune. A failure to publish is reported, not raised, and what follows is done. ``index`` in the
        result is the folder that ``stored_postings`` reads.
        """
        done: dict[str, object] = self.compact()
        rows = self.read()
        terms, stats = postings(rows)
        folder = f"{index.rstrip('/')}/postings-{uuid.uuid4().hex}"
        terms.repartitionByRange("term").write.parquet(f"{folder}/terms")
        stats.write.parquet(f"{folder}/stats")
        done["index"], done["error"] = folder, None
        if publish is not None:
            try:
                publish(rows)
            except Exception as error:  # noqa: BLE001 - the hook is the caller's, and the rest must be done
                done["error"] = str(error)
        done["pruned"] = self.prune(older_than=older_than)
        return done


def stored_postings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What ``finalize`` stored, as ``bm25_top_k`` and ``hybrid_search`` take it. Terms are sorted over files, so a
    search's filter on terms skips most of them.
    """
    return spark.read.parquet(f"{folder}/terms"), spark.read.parquet(f"{folder}/stats")


def usable_postings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | bool:
    """The stored postings, or False with a warning where they are missing or can't be read, as ``hybrid_search``
    takes it: then vectors alone answer. A store without a snapshot reads as an empty table, so it has no hits.
    """
    try:
        return stored_postings(spark, folder)
    except AnalysisException as error:
        warnings.warn(f"no postings in {folder}, searching by vectors alone: {error.getCondition()}", stacklevel=2)
        return False


def without_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """M1 for many documents at once: rows whose (collection, document_name) is in none of ``documents``."""
    return chunks.join(documents, ["collection", "document_name"], "left_anti")


def without_tails(chunks: DataFrame, watermarks: DataFrame) -> DataFrame:
    """M2 for many documents: rows at or past their document's ``watermark`` go."""
    marks = watermarks.select("collection", "document_name", "watermark")
    return chunks.join(marks, ["collection", "document_name"], "left").where(F.col("watermark").isNull() | (F.col("chunk_index") < F.col("watermark"))).drop("watermark")


def overwritten(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """M4 as a plan: documents with at least one new chunk are replaced, the others stay."""
    fresh = new.select("collection", "document_name").distinct()
    return without_documents(chunks, fresh).unionByName(new)


def merged(current: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``changed`` in place of those with their key."""
    return current.join(changed.select(*key), key, "left_anti").unionByName(changed)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
