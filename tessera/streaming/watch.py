"""Changes of files as a stream: debounced batches by collection, and a throttle for what follows them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BATCH = "database string, collection string, path string, deleted boolean, bulk boolean, flushed_ms long"
BATCH_COLUMNS = [c.split()[0] for c in BATCH.split(", ")]
STATE = "first_ms long, last_ms long, paths array<string>, deleted array<boolean>, seqs array<long>"


def debounced(events: DataFrame, quiet_ms: int = 1000, longest_ms: int = 5000, bulk: int = 50) -> DataFrame:
    """The stream of changes (database, collection, path, deleted, ts, seq) in batches by (database, collection).

    A batch is closed ``quiet_ms`` after its last event or ``longest_ms`` after its first, in event time, whichever comes
    first: a session window with a longest length, which no built-in window has. Only the last event of a path counts;
    more than ``bulk`` paths make one row without a path, which asks for a scan. ``events`` must have a watermark on ts.
    State holds the open batch of each key alone, at most ``bulk`` paths and a mark beyond.
    """

    def rows(key: tuple, state: tuple, at: int) -> pd.DataFrame:
        _, _, paths, deleted, _ = state
        many = len(paths) > bulk
        names, gone = ([None], [False]) if many else (list(paths), list(deleted))
        return pd.DataFrame({"database": key[0], "collection": key[1], "path": names, "deleted": gone, "bulk": many, "flushed_ms": at})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            if held is not None:
                state.remove()
                yield rows(key, held, min(held[1] + quiet_ms, held[0] + longest_ms))
            return
        batch = pd.concat(list(frames), ignore_index=True)
        batch["ms"] = batch["ts"].astype("datetime64[ms]").astype("int64")
        seen: dict[str, tuple[bool, int]] = {}
        first = last = None
        if held is not None:
            first, last = held[0], held[1]
            seen = {p: (d, s) for p, d, s in zip(held[2], held[3], held[4])}
        for ms, seq, path, gone in batch.sort_values(["ms", "seq"])[["ms", "seq", "path", "deleted"]].itertuples(index=False):
            if first is not None and ms >= min(last + quiet_ms, first + longest_ms):
                state_now = (first, last, [*seen], [d for d, _ in seen.values()], [s for _, s in seen.values()])
                yield rows(key, state_now, min(last + quiet_ms, first + longest_ms))
                seen, first = {}, None
            first = ms if first is None else first
            last = ms
            if path in seen or len(seen) <= bulk:
                seen[path] = (bool(gone), int(seq))
        due = min(last + quiet_ms, first + longest_ms)
        now = state.getCurrentWatermarkMs()
        if due <= now:
            if state.exists:
                state.remove()
            yield rows(key, (first, last, [*seen], [d for d, _ in seen.values()], None), due)
            return
        state.update((first, last, [*seen], [d for d, _ in seen.values()], [s for _, s in seen.values()]))
        state.setTimeoutTimestamp(max(due, now + 1))

    keyed = events.select("database", "collection", "path", "deleted", "ts", "seq").groupBy("database", "collection")
    return keyed.applyInPandasWithState(step, BATCH, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def debounced_batch(events: DataFrame, quiet_ms: int = 1000, longest_ms: int = 5000, bulk: int = 50) -> DataFrame:
    """The same batches of a finished table of events, to replay a log. Each key's events stream in order of (ts, seq) past the
    batch that is open, of which a task holds at most ``bulk`` + 1 paths; no row has more than one event or path.
    """

    def fold(batches):
        key = None
        first = last = 0
        paths: dict[str, bool] = {}
        out: list[tuple] = []

        def close() -> None:
            if key is not None:
                at, many = min(last + quiet_ms, first + longest_ms), len(paths) > bulk
                out.extend([(*key, None, False, True, at)] if many else [(*key, path, gone, False, at) for path, gone in paths.items()])
                paths.clear()

        def told() -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, t in enumerate(types)], names=BATCH_COLUMNS)
            out.clear()
            return made

        for batch in batches:
            for database, collection, path, gone, ms in zip(*(c.to_pylist() for c in batch.columns)):
                own = (database, collection)
                if own != key or ms >= min(last + quiet_ms, first + longest_ms):
                    close()
                    key, first = own, ms
                last = ms
                if path in paths or len(paths) <= bulk:
                    paths[path] = bool(gone)
            yield told()
        close()
        yield told()

    ms = F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")
    rows = events.select("database", "collection", "path", "deleted", ms, "seq")
    ordered = rows.repartition("database", "collection").sortWithinPartitions("database", "collection", "ms", "seq")
    return ordered.select("database", "collection", "path", "deleted", "ms").mapInArrow(fold, BATCH)


def last_event_wins(events: DataFrame) -> DataFrame:
    """The last change of each path."""
    return events.groupBy("database", "collection", "path").agg(F.max_by("deleted", F.struct("ts", "seq")).alias("deleted"))


def throttled(requests: DataFrame, interval_s: int = 30) -> DataFrame:
    """Of requests (database, ts), the times at which they are met: at once if ``interval_s`` have gone by since the last,
    else once when they have. Each database's requests stream in order past the last time that was met, the only thing
    a task holds of them.
    """
    width = interval_s * 1_000_000

    def meet(batches):
        own, last = None, None
        for batch in batches:
            names, met = [], []
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != own or last is None or at > last:
                    last = at if name != own or last is None else max(at, last + width)
                    own = name
                    names.append(name)
                    met.append(last)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(met, pa.int64())], names=["database", "us"])

    asked = requests.select(F.col("database").cast("string").alias("database"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where("us IS NOT NULL")
    ordered = asked.repartition("database").sortWithinPartitions("database", "us")
    return ordered.mapInArrow(meet, "database string, us long").select("database", F.timestamp_micros("us").alias("ts"))


def apply_batches(batches: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second"):
    """Run ``index(rows, batch id)`` on every micro-batch of debounced changes. What it writes must be keyed by the
    batch id, so that a batch that is run again changes nothing; the checkpoint takes the place of a spool of open jobs (G12).
    """
    return batches.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
