"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import documents
from tessera.llm._words import mixed

#: Cells of a fingerprint; each digest goes to one cell of each of PARTS parts.
CELLS, PARTS = 24, 3


def paragraphs(text: str) -> list[str]:
    """Non-empty lines; a line of several sentences gives one paragraph for each."""
    for end in ".!?":
        text = text.replace(f"{end} ", f"{end}\n")
    return [p for p in map(str.strip, text.split("\n")) if p]


def digests(text: str) -> np.ndarray:
    """A 64-bit digest of each paragraph; one that comes again gets another digest, so that all are distinct."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        again = seen.get(p, 0)
        seen[p] = again + 1
        out.append(xxhash.xxh64_intdigest(p.encode("utf-8", "replace"), seed=again))
    return np.array(out, dtype=np.uint64)


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The PARTS cells of each key, (n, PARTS); they depend on the size, so a larger sketch also hashes anew."""
    part = cells // PARTS
    seeds = (np.arange(1, PARTS + 1, dtype=np.uint64) + np.uint64(cells << 8)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed(keys[:, None] ^ seeds[None, :]) % np.uint64(part)).astype(np.int64) + np.arange(PARTS) * part


def _check(keys: np.ndarray) -> np.ndarray:
    return mixed(keys + np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)


def sketches(sets: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, key sums and check sums (by exclusive or), each (sets, cells)."""
    count, key, check = np.zeros((len(sets), cells), np.int64), np.zeros((len(sets), cells), np.uint64), np.zeros((len(sets), cells), np.uint64)
    if sum(map(len, sets)):
        keys = np.concatenate(sets)
        place = _places(keys, cells) + np.repeat(np.arange(len(sets)), [len(s) for s in sets])[:, None] * cells
        np.add.at(count.ravel(), place.ravel(), 1)
        np.bitwise_xor.at(key.ravel(), place.ravel(), np.repeat(keys, PARTS))
        np.bitwise_xor.at(check.ravel(), place.ravel(), np.repeat(_check(keys), PARTS))
    return count, key, check


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The digests that only the first and only the second of each subtracted pair has, and whether all were recovered.

    Cells that hold a single digest give it away; it leaves its other cells, and the next become single.
    """
    n, cells = count.shape
    gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        flat = np.flatnonzero(np.abs(count) == 1)
        found = key.ravel()[flat]
        flat = flat[_check(found) == check.ravel()[flat]]
        if not len(flat):
            break
        found, row = key.ravel()[flat], flat // cells
        place = _places(found, cells) + row[:, None] * cells
        single = np.zeros(count.size, bool)
        single[flat] = True
        # A digest alone in several cells is taken from the first of them.
        once = place[np.arange(len(flat)), single[place].argmax(axis=1)] == flat
        row, found, place, sign = row[once], found[once], place[once], count.ravel()[flat[once]]
        if not len(row):
            break
        np.subtract.at(count.ravel(), place.ravel(), np.repeat(sign, PARTS))
        np.bitwise_xor.at(key.ravel(), place.ravel(), np.repeat(found, PARTS))
        np.bitwise_xor.at(check.ravel(), place.ravel(), np.repeat(_check(found), PARTS))
        gone.append((row, found, sign))
        if len(gone) > cells * 4:  # a false single cell can go round in circles: not recovered at this size
            break
    whole = (count == 0).all(axis=1) & (key == 0).all(axis=1) & (check == 0).all(axis=1)
    row, found, sign = (np.concatenate(c) for c in zip(*gone)) if gone else (np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int))
    order = np.argsort(row, kind="stable")
    row, found, sign = row[order], found[order], sign[order]
    at = np.searchsorted(row, np.arange(n + 1))
    spans = [slice(a, b) for a, b in zip(at[:-1], at[1:])]
    return [found[s][sign[s] > 0] for s in spans], [found[s][sign[s] < 0] for s in spans], whole


def differences(first: list[np.ndarray], second: list[np.ndarray], cells: int = CELLS, most_tries: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """What only the first and only the second set of each pair has: sketches are subtracted and peeled, and pairs that
    do not come out whole are tried again at four times the cells. Beyond 64 cells a digest, which peel but for bad luck,
    they get a part more each time, as each size hashes anew.
    """
    out: list = [None] * len(first)
    todo = np.arange(len(first))
    largest = 64 * (max([1, *(len(a) + len(b) for a, b in zip(first, second))]) + cells)
    for _ in range(most_tries):
        a, b = sketches([first[i] for i in todo], cells), sketches([second[i] for i in todo], cells)
        mine, other, whole = peel(a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2])
        for k in np.flatnonzero(whole):
            out[todo[k]] = (mine[k], other[k])
        todo = todo[~whole]
        if not len(todo):
            return out
        cells = cells * 4 if cells * 4 <= largest else cells + PARTS
    raise RuntimeError(f"{len(todo)} pairs of sketches did not peel in {most_tries} sizes")


def likeness(first: list[np.ndarray], second: list[np.ndarray]) -> list[float]:
    """Shared digests over all digests of each pair, as the peeled differences tell; two empty sets are alike."""
    out = []
    for a, b, (only_a, only_b) in zip(first, second, differences(first, second)):
        total = len(a) + len(only_b)
        out.append((len(a) - len(only_a)) / total if total else 1.0)
    return out


def as_text(count: np.ndarray, key: np.ndarray, check: np.ndarray) -> list[str]:
    """A fingerprint of each row of cells as text: counts (modulo 2^16), keys and checks, little-endian, base 64."""
    packed = np.zeros(count.shape, dtype=[("n", "<u2"), ("key", "<u8"), ("check", "<u4")])
    packed["n"], packed["key"], packed["check"] = count & 0xFFFF, key, check
    return [base64.b64encode(row.tobytes()).decode() for row in packed]


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
KIND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_by(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _results(run: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    texts, after = [t for _, t, _ in run], [f for _, _, f in run]
    edited = [edited_by(t, f) for _, t, f in run]
    known: dict[str, np.ndarray] = {}
    own, new, following = ([known[t] if t in known else known.setdefault(t, digests(t)) for t in group] for group in (texts, edited, after))
    columns = [
        [i for i, _, _ in run],
        [len(t) for t in texts],
        [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited],
        as_text(*sketches(own, CELLS)),
        as_text(*sketches(new, CELLS)),
        likeness(own, new),
        likeness(own, following),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT)], schema=RESULT)


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 32, most_blocks: int = 4096, chars_at_once: int = 1 << 21
) -> DataFrame:
    """Fingerprints of every text and of the text after an edit, with what the sketches tell of their likeness.

    The edit puts the first half-length of the next document, by descending id (after the last: the first), in place
    of the last half. Next documents meet by one shuffle of the texts: ids are cut into blocks at quantiles that are
    ids themselves (at most ``most_blocks``, so the driver holds a bounded list). The highest id of a block is one of
    these bounds, so each bound's row is sent to the block above as well, where it follows that block's last row.
    Sorted blocks stream through a worker, about ``chars_at_once`` characters at a time.

    A null text counts as empty. Rows of equal id follow each other by text; null ids come last. One row follows
    itself; an empty table gives an empty one. Equal texts have equal fingerprints. Columns but id and text aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    place = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    told = rows.select(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("top")).first()
    blocks = max(1, min(most_blocks, told["n"] // rows_per_block))
    cuts: list[int] = []
    if blocks > 1:
        asked = F.percentile_approx("place", [k / blocks for k in range(1, blocks)], 100_000)
        cuts = sorted(set(rows.select(place.alias("place")).agg(asked.alias("cuts")).first()["cuts"]) - {told["top"]})
    top = told["top"]

    @F.pandas_udf("array<int>")
    def homes(places):
        """Block of each row, and the block above (or 0 for the top) where the row is a bound, as -1 - block."""
        import pandas as pd

        bounds = np.array(cuts, dtype=np.int64)
        at = np.searchsorted(bounds, places.to_numpy(), side="left")
        own = places.to_numpy()
        edge = np.isin(own, bounds)
        return pd.Series([[b, *([-2 - b] if e else []), *([-1] if v == top else [])] for b, e, v in zip(at.tolist(), edge.tolist(), own.tolist())])

    dealt = rows.withColumn("place", place).withColumn("home", F.explode(homes("place")))
    dealt = dealt.withColumn("tail", F.col("home") < 0).withColumn("block", F.when(F.col("home") < 0, -1 - F.col("home")).otherwise(F.col("home")))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "tail", F.desc("place"), "text").select("block", "tail", "doc_id", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple] = []
        size = 0
        last = None
        for batch in batches:
            for block, tail, key, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if last is not None and last[0] == block:
                    run.append((last[1], last[2], text))
                    size += len(text) + 1
                    if size >= chars_at_once:
                        yield _results(run)
                        run, size = [], 0
                last = None if tail else (block, key, text)
        if run:
            yield _results(run)

    return dealt.mapInArrow(stream, KIND)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
