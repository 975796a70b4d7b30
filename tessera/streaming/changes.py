"""Changes of a directory tree as a streaming Data Source, whose offsets are listings."""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.sources.discovery import SKIPPED, is_deletable, is_indexable
from tessera.sources.listing import _entries

SCHEMA = "database string, collection string, path string, relative string, deleted boolean, ts timestamp, seq long"


class Buckets(InputPartition):
    def __init__(self, listing: int, bucket: int) -> None:
        self.listing, self.bucket = listing, bucket


class FileChanges(DataSource):
    """``spark.readStream.format("file_changes")`` with options root, state, database, collection.

    Every trigger lists the tree; if something has changed since the last listing that was kept, the new one is kept below
    ``state``, a folder that driver and executors share, and its number is the new offset. A batch is the difference of two
    listings, found bucket by bucket in tasks: a file that is new, or of another time or size, is a change; one that is gone is a
    deletion; a rename is both. A batch that is run again reads the same two listings. With ``enabled`` false nothing is ever
    watched, for tables that are synchronized on request only.
    """

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FileChangesReader(dict(self.options))


class FileChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["root"].rstrip("/")
        self.state = options["state"].rstrip("/")
        self.key = options.get("database", "default"), options.get("collection", "default")
        self.buckets = int(options.get("buckets", "16"))
        self.enabled = options.get("enabled", "true").lower() != "false"

    # listings that are kept

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.state)

    def _path(self, listing: int, name: str) -> str:
        return f"{self._store()[1]}/listing-{listing}/{name}"

    def _kept(self) -> list[int]:
        from pyarrow import fs

        store, base = self._store()
        store.create_dir(base, recursive=True)
        return sorted(int(i.base_name[8:]) for i in store.get_file_info(fs.FileSelector(base)) if i.base_name.startswith("listing-"))

    def _read(self, listing: int, name: str) -> dict:
        if listing == 0:
            return {}
        store, _ = self._store()
        with store.open_input_stream(self._path(listing, name)) as stream:
            return json.loads(stream.read().decode())

    def _files(self) -> Iterator[tuple[str, list[float]]]:
        folders = [""]
        while folders:
            for relative, _, is_folder, size, modified, inside, _, error in _entries(self.root, folders.pop(), ()):
                if error is not None:
                    raise OSError(error)  # no deletions from a part of the tree: the stream tries again or stops
                name = relative.rsplit("/", 1)[-1]
                if is_folder and not name.startswith(".") and name not in SKIPPED:
                    folders.append(relative)
                elif not is_folder and inside:
                    yield relative, [modified.timestamp(), size]

    def _list(self, after: int) -> int:
        """The number of a new listing, or ``after`` if that is what the tree still is."""
        found: list[dict] = [{} for _ in range(self.buckets)]
        for relative, told in self._files():
            found[zlib.crc32(relative.encode()) % self.buckets][relative] = told
        if all(found[b] == self._read(after, f"{b}.json") for b in range(self.buckets)):
            return after
        store, base = self._store()
        draft = f"{base}/draft-{uuid.uuid4().hex}"
        store.create_dir(draft)
        for name, content in [*((f"{b}.json", f) for b, f in enumerate(found)), ("at.json", {"at": time.time()})]:
            with store.open_output_stream(f"{draft}/{name}") as out:
                out.write(json.dumps(content).encode())
        store.move(draft, f"{base}/listing-{after + 1}")
        return after + 1

    # the stream

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        kept = self._kept()
        last = kept[-1] if kept else 0
        return {"listing": self._list(last) if self.enabled else last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Buckets(n, b) for n in range(start["listing"] + 1, end["listing"] + 1) for b in range(self.buckets)]

    def read(self, partition: Buckets) -> Iterator[tuple]:
        before, after = (self._read(n, f"{partition.bucket}.json") for n in (partition.listing - 1, partition.listing))
        at = datetime.fromtimestamp(self._read(partition.listing, "at.json")["at"], timezone.utc)
        changed = [(name, False) for name, told in after.items() if before.get(name) != told] + [(name, True) for name in before if name not in after]
        for place, (name, deleted) in enumerate(sorted(changed)):
            seq = (partition.listing << 40) + place * self.buckets + partition.bucket
            yield (*self.key, f"{self.root}/{name}", name, deleted, at, seq)

    def commit(self, end: dict) -> None:
        store, base = self._store()
        for listing in self._kept():
            if listing < end["listing"] - 1:
                store.delete_dir(f"{base}/listing-{listing}")


def file_changes(spark: SparkSession, root: str, state: str, database: str = "default", collection: str = "default", enabled: bool = True) -> DataFrame:
    """The stream of changes below ``root``, as ``debounced`` takes it once it has a watermark on ts."""
    spark.dataSource.register(FileChanges)
    options = {"root": root, "state": state, "database": database, "collection": collection, "enabled": str(enabled).lower()}
    return spark.readStream.format("file_changes").options(**options).load()


def admitted_changes(events: DataFrame, lines: list[str] = ()) -> DataFrame:
    """Events of files that may come in: a deletion by its name alone, any other by the ignore rules ``lines`` too."""
    relative = F.col("relative")
    return events.where(F.when(F.col("deleted"), is_deletable(relative)).otherwise(is_indexable(relative, list(lines))))
