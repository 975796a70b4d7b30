"""Tokens of texts counted in their rows, and rows scored by the tokens that queries ask for."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

TERMS = "array<struct<term:string,tf:int>>"
#: Pairs of tokens and queries scored at once, and four times the tokens counted so: what bounds a worker's arrays whatever a batch holds.
MOST_PAIRS = 1 << 20


def parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows whose ``sizes`` sum to ``most`` or less, or that are one row."""
    total, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def counted_terms(rows: DataFrame, tokens: str = "tokens", only: list[str] | None = None) -> DataFrame:
    """``rows`` with ``terms``, (term, tf) of the array ``tokens``, in place of it, of the terms ``only`` if some are named:
    counted in the row, without a shuffle, a part of ``MOST_PAIRS`` tokens at a time.
    """
    others = [c for c in rows.columns if c != tokens]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def counted(batches):
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(tokens)), 0).to_numpy(zero_copy_only=False)
            for begin, end in parts(sizes, MOST_PAIRS // 4):
                yield part(batch.slice(begin, end - begin))

    def part(batch):
        lists = batch.column(tokens)
        words = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(batch)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        code, width = words.indices.to_numpy(), max(1, len(words.dictionary))
        if only is not None:
            named = pa.compute.is_in(words.dictionary, pa.array(only, words.dictionary.type)).to_numpy(zero_copy_only=False)[code]
            row, code = row[named], code[named]
        both, tf = np.unique(row.astype(np.int64) * width + code, return_counts=True)
        offsets = np.searchsorted(both, np.arange(len(batch) + 1, dtype=np.int64) * width).astype(np.int32)
        terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(both % width)), pa.array(tf.astype(np.int32))], names=["term", "tf"])
        arrays = [*(batch.column(c) for c in others), pa.ListArray.from_arrays(pa.array(offsets), terms)]
        return pa.RecordBatch.from_arrays(arrays, names=[*others, "terms"])

    return rows.mapInArrow(counted, ", ".join([*(f"{c} {types[c]}" for c in others), f"terms {TERMS}"]))


def batch_best(rows: DataFrame, key: tuple[str, ...], asked: dict, average: float, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, *key, score): of some rows (key, length, terms) at a time the ``k`` best by BM25 for each of ``asked`` (id to
    term and weight), ties by ``key``; rows without a term of the query are none. Rows are taken in parts, of which about
    ``MOST_PAIRS`` pairs of a row and a query's term are held.
    """
    ids = list(asked)
    pairs = sorted((term, n, weight) for n, i in enumerate(ids) for term, weight in asked[i].items())
    known = sorted({term for term, _, _ in pairs})
    ends = np.cumsum([n for _, n in sorted(Counter(term for term, _, _ in pairs).items())], dtype=np.int64)
    begins = np.append(0, ends)[:-1]
    query, weights = np.array([n for _, n, _ in pairs], np.int64), np.array([w for _, _, w in pairs], np.float64)
    id_type = "long" if all(isinstance(i, int) for i in ids) else "string"

    def best(batches):
        vocabulary = pa.array(known, pa.string())
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([(c, "ascending") for c in key])
            terms = table.column("terms").combine_chunks()
            length = table.column("length").to_numpy().astype(np.float64)
            code = pa.compute.fill_null(pa.compute.index_in(terms.flatten().field("term"), vocabulary), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(table)), pa.compute.fill_null(pa.compute.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
            have = np.flatnonzero(code >= 0)
            code, row, tf = code[have], row[have], terms.flatten().field("tf").to_numpy(zero_copy_only=False)[have].astype(np.float64)
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / average))
            width = ends[code] - begins[code]
            at, total = 0, np.cumsum(width)
            while at < len(row):
                end = np.searchsorted(total, (total[at - 1] if at else 0) + MOST_PAIRS, "right")
                end = max(np.searchsorted(row, row[min(end, len(row) - 1)]) if end < len(row) else len(row), np.searchsorted(row, row[at], "right"))
                n = width[at:end]
                entry = np.repeat(np.arange(at, end), n)
                pair = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begins[code[entry]]
                place, inverse = np.unique(query[pair] * len(table) + row[entry], return_inverse=True)
                score = np.round(np.bincount(inverse, weights[pair] * part[entry], len(place)), 9)
                q, v = place // len(table), place % len(table)
                order = np.lexsort([v, -score, q])
                q, v, score = q[order], v[order], score[order]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, v, score = q[kept], v[kept], score[kept]
                columns = [pa.array([ids[n] for n in q], pa.int64() if id_type == "long" else pa.string()), *(table.column(c).take(pa.array(v)).combine_chunks() for c in key), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", *key, "score"])
                at = end

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*key, "length", "terms").mapInArrow(best, f"query_id {id_type}, " + ", ".join(f"{c} {types[c]}" for c in key) + ", score double")
