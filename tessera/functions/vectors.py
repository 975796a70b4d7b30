"""Vector expressions, and pluggable text embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: R2: what a query gets in front.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
#: The distance of rows that have no direction.
NO_DISTANCE = 2.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v))


def unit(a: Column) -> Column:
    """L2-normalized; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: (v / n).cast("float"))).otherwise(a)


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cosine in double precision; 2.0 for a missing or zero vector or a zero query."""
    q = np.asarray(query, dtype=np.float64)
    size = float(np.sqrt((q * q).sum()))
    if size == 0:
        return F.lit(NO_DISTANCE)
    literal = F.array(*[F.lit(float(v)) for v in q])
    n = norm(vector)
    return F.when(vector.isNull() | (n == 0), F.lit(NO_DISTANCE)).otherwise(1 - dot(vector, literal) / (n * F.lit(size)))


def pair_distance(a: Column, b: Column) -> Column:
    """The same for two vector columns."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, 1 - dot(a, b) / n), F.lit(NO_DISTANCE))


def similarity(distance: Column) -> Column:
    """P3, with the range check of P2: distances beyond [0, 2] by more than 1e-6 are errors."""
    low, high = F.lit(0.0), F.lit(NO_DISTANCE)
    bad = (distance < low - 1e-6) | (distance > high + 1e-6)
    return F.when(bad, F.raise_error(F.concat(F.lit("distance out of range: "), distance.cast("string"))).cast("double")).otherwise(F.round(1 - distance, 4))


class Backend(Protocol):
    """An embedding model. ``load`` runs once in a worker and returns a function from texts to rows of floats."""

    dimension: int

    def load(self) -> Callable[[list[str]], np.ndarray]: ...


class HashingBackend:
    """Deterministic default: signed hashed word unigrams and bigrams of a text's first ``max_tokens`` words, the limit that
    models of sentences have. No model file is needed.
    """

    def __init__(self, dimension: int = 256, max_tokens: int = 512):
        self.dimension, self.max_tokens = dimension, max_tokens

    def load(self) -> Callable[[list[str]], np.ndarray]:
        import re
        from itertools import islice
        from zlib import crc32

        word = re.compile(r"[^\W_]+")

        def embed(texts: list[str]) -> np.ndarray:
            hashes, sizes = [], []
            for text in texts:
                words = [m[0].encode() for m in islice(word.finditer(text.lower()), self.max_tokens)]
                own = list(map(crc32, words))
                hashes += own
                hashes += map(crc32, map(b" ".__add__, words[1:]), own)  # of "a b": the hash of "a" goes on over " b"
                sizes.append(max(0, 2 * len(words) - 1))
            h = np.array(hashes, np.int64)
            place = np.repeat(np.arange(len(texts)), sizes) * self.dimension + h % self.dimension
            signed = np.bincount(place, np.where(h & 0x80000000, 1.0, -1.0), len(texts) * self.dimension)
            return signed.astype(np.float32).reshape(len(texts), self.dimension)

        return embed


def embed(text: Column, backend: Backend, batch: int = 32) -> Column:
    """Unit vectors of texts, ``batch`` texts at a time; the model is loaded once for each worker's stream."""

    @F.pandas_udf("array<float>")
    def vectors(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = backend.load()
        for texts in frames:
            values = texts.fillna("").tolist()
            rows: list[np.ndarray] = []
            for at in range(0, len(values), batch):
                got = np.asarray(model(values[at : at + batch]), dtype=np.float32)
                size = np.linalg.norm(got, axis=1, keepdims=True)
                rows.extend(np.divide(got, size, out=got.copy(), where=size > 0))
            yield pd.Series(rows, dtype=object)

    return vectors(text)


def embed_query(query: str, backend: Backend) -> list[float]:
    """R2: the vector of one query, on the driver."""
    v = np.asarray(backend.load()([QUERY_PREFIX + query]), dtype=np.float64)[0]
    size = np.linalg.norm(v)
    return (v / size if size > 0 else v).tolist()


METRICS = ("cosine", "l2", "dot")


def distance(vector: Column, query: list[float], metric: str = "cosine") -> Column:
    """The distance by ``metric``: 1 - cosine, the squared Euclidean distance, or 1 - the inner product. Missing vectors,
    for the cosine also zero ones, are at ``NO_DISTANCE`` by the cosine and infinitely far by the others.
    """
    if metric == "cosine":
        return cosine_distance(vector, query)
    literal = F.array(*[F.lit(float(v)) for v in query])
    if metric == "dot":
        found = 1 - dot(vector, literal)
    elif metric == "l2":
        off = F.zip_with(vector.cast("array<double>"), literal, lambda x, y: (x - y) * (x - y))
        found = F.aggregate(off, F.lit(0.0), lambda s, v: s + v)
    else:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    return F.coalesce(found, F.lit(float("inf")))


def batch_top_k(rows: DataFrame, key: tuple[str, ...], vector: str, asked: dict, k: int) -> DataFrame:
    """(query_id, *key, distance): of each Arrow batch of ``rows`` the ``k`` nearest by the cosine distance to each of ``asked``
    (id to vector), ties by ``key``. So few remain of many rows that a window ranks them.

    A product of matrices picks them with a margin for its rounding; their distances are then summed component by component,
    as ``pair_distance`` does, so both give the same numbers.
    """
    ids = list(asked)
    if len({len(v) for v in asked.values()}) > 1:
        raise ValueError("queries of one batch have vectors of different numbers of components")
    queries = np.array([asked[i] for i in ids], np.float64).reshape(len(ids), len(asked[ids[0]]) if ids else 0)
    sizes = np.sqrt(np.cumsum(queries * queries, axis=1)[:, -1]) if queries.size else np.zeros(len(ids))
    id_type = "long" if all(isinstance(i, int) for i in ids) else "string"

    def nearest(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([(c, "ascending") for c in key])
            own = table.column(vector).combine_chunks()
            length = pa.compute.fill_null(pa.compute.list_value_length(own), -1).to_numpy()
            fit = np.flatnonzero(length == queries.shape[1])
            if len(table) - len(fit) > k:  # of rows without a direction the first k by key are enough
                few = np.sort(np.append(fit, np.flatnonzero(length != queries.shape[1])[:k]))
                table, length = table.take(pa.array(few)), length[few]
                own, fit = table.column(vector).combine_chunks(), np.flatnonzero(length == queries.shape[1])
            x = own.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), queries.shape[1])
            lengths = np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) if x.size else np.zeros(len(fit))
            for at in range(0, len(ids), 256):
                part = slice(at, at + 256)
                far = np.full((len(queries[part]), len(table)), NO_DISTANCE)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = (queries[part] @ x.T) / (sizes[part, None] * lengths[None, :])
                far[:, fit] = np.where(np.isfinite(cosine), 1 - cosine, NO_DISTANCE)
                least = np.partition(far, min(k, len(table)) - 1, axis=1)[:, min(k, len(table)) - 1] if len(table) else np.zeros(len(far))
                q, v = np.nonzero(far <= least[:, None] + 1e-9)
                place = np.searchsorted(fit, v)
                known = (place < len(fit)) & (fit[np.minimum(place, max(0, len(fit) - 1))] == v) if len(fit) else np.zeros(len(v), bool)
                exact = np.full(len(v), NO_DISTANCE)
                for some in np.array_split(np.flatnonzero(known), max(1, known.sum() // 65536)):
                    if len(some):
                        both = np.cumsum(x[place[some]] * queries[part][q[some]], axis=1)[:, -1]
                        norms = lengths[place[some]] * sizes[part][q[some]]
                        exact[some] = np.where(norms > 0, 1 - both / np.where(norms > 0, norms, 1), NO_DISTANCE)
                order = np.lexsort([v, exact, q])
                q, v, exact = q[order], v[order], exact[order]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, v, exact = q[kept], v[kept], exact[kept]
                columns = [pa.array([ids[at + n] for n in q], pa.int64() if id_type == "long" else pa.string()), *(table.column(c).take(pa.array(v)).combine_chunks() for c in key), pa.array(exact)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", *key, "distance"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"query_id {id_type}, " + ", ".join(f"{c} {types[c]}" for c in key) + ", distance double"
    return rows.select(*key, vector).mapInArrow(nearest, schema)
