"""Near-duplicate embeddings by lattice hashing: E8 cells of random projections, neighbouring cells probed, cosine verified."""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._clusters import blocks, components, linked, paired, star_edges, told
from tessera.llm._common import written


def nearest_d8(y: np.ndarray, half: bool) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point of D8 (or of D8 + 1/2) to each row of 8, and its squared distance: round all, and where the sum
    is odd round the coordinate that lay furthest off the other way.
    """
    shift = 0.5 if half else 0.0
    point = np.rint(y - shift) + shift
    off = y - point
    worst = np.abs(off).argmax(axis=-1)[..., None]
    odd = np.rint((point - shift).sum(axis=-1, keepdims=True)) % 2 != 0
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0)
    np.put_along_axis(point, worst, np.take_along_axis(point, worst, -1) + np.where(odd, step, 0.0), -1)
    return point, ((y - point) ** 2).sum(axis=-1)


def lattice_cells(y: np.ndarray, probes: int) -> np.ndarray:
    """Hashes of the home cell and of ``probes`` neighbours, shape (n, tables, 1 + probes), for y of shape (n, tables, parts, 8).

    E8 is D8 and D8 + 1/2 together. A neighbour takes, in some parts, the point of the other coset; those with the
    least added distance are probed.
    """
    whole, d0 = nearest_d8(y, False)
    shifted, d1 = nearest_d8(y, True)
    closer = (d0 <= d1)[..., None]
    home, other, added = np.where(closer, whole, shifted), np.where(closer, shifted, whole), np.abs(d0 - d1)
    parts = y.shape[2]
    switch = np.array([s for s in product((0, 1), repeat=parts) if any(s)], dtype=float)
    chosen = np.argsort(added @ switch.T, axis=-1, kind="stable")[..., :probes]
    odd = np.random.default_rng(3).integers(1, 1 << 62, size=(parts, 8)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def hashed(point: np.ndarray) -> np.ndarray:
        return ((2 * point).astype(np.int64).astype(np.uint64) * odd).sum(axis=-1)

    h, o = hashed(home), hashed(other)
    probed = np.where(switch[chosen].astype(bool), o[:, :, None, :], h[:, :, None, :]).sum(axis=-1)
    return np.concatenate([h.sum(axis=-1)[..., None], probed], axis=-1)


def link_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least_cosine: float = 0.98,
    tables: int = 12,
    parts: int = 3,
    probes: int = 3,
    scale: float = 0.6,
    seed: int = 5,
    rows_per_block: int = 256,
) -> DataFrame:
    """Links between vectors of equal label whose cosine is ``least_cosine`` or more, and their components.

    Each of ``tables`` tables projects a unit vector to ``parts`` x 8 Gaussian directions, times ``scale``, and decodes
    every 8 to a point of the lattice E8; label, dimension, table and points name a cell. A vector enters its home
    cell and ``probes`` neighbouring cells. Cells of one vector fall away; the rest joins vectors into groups, in which
    all pairs are verified by cosine in double precision, block against block. With more than about 10^6 vectors of a
    label raise ``parts`` and ``tables``: a random pair then shares a cell less often.

    Equal vectors of a label are one node with a count, so copies are never expanded. Null, zero or non-finite vectors,
    null labels and null ids link with nothing. Rows that repeat an id are rows of their own, with one vector or several; each
    has its result. An empty table gives an empty one.
    Returns id, n_links, component_id, kept; other columns aren't read.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label")
    )

    def keyed(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            prints: list = [None] * len(batch)
            keys: list = [None] * len(batch)
            sizes: dict[int, list[int]] = {}
            units: dict[int, np.ndarray] = {}
            labels = batch.column(2).to_pylist()
            for at, (key, vector, label) in enumerate(zip(batch.column(0), batch.column(1), labels)):
                if not (key.is_valid and vector.is_valid) or label is None or vector.values.null_count:
                    continue
                v = vector.values.to_numpy()
                largest = np.abs(v).max(initial=0.0)
                if np.isfinite(largest) and largest > 0:
                    v = v / largest
                    units[at] = v / np.sqrt(v @ v)
                    sizes.setdefault(len(v), []).append(at)
            for dim, places in sizes.items():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(0.0, scale, (dim, tables * parts * 8))
                x = np.array([units[at] for at in places])
                cells = lattice_cells((x @ planes[dim]).reshape(len(x), tables, parts, 8), probes)
                for at, unit, own in zip(places, x, cells):
                    label = f"{labels[at]}\0{dim}\0".encode()
                    salt = np.frombuffer(hashlib.blake2b(label, digest_size=8).digest(), np.uint64)
                    table = np.arange(1, tables + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
                    mixed = ((own ^ salt) + table) * np.uint64(0xBF58476D1CE4E5B9)
                    prints[at] = hashlib.blake2b(label + unit.tobytes(), digest_size=16).hexdigest()
                    keys[at] = mixed.ravel().view(np.int64).tolist()
            arrays = [batch.column(0), batch.column(1), pa.array(prints, pa.string()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "vector", "print", "keys"])

    marked = written(rows.mapInArrow(keyed, "id long, vector array<double>, print string, keys array<long>"), "lattice-keys")
    classes = marked.where(F.col("print").isNotNull()).groupBy("print").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("vector", "keys"), F.struct("id", "vector")).alias("own")
    )
    classes = written(classes.select("print", "rep", "copies", "own.*", F.monotonically_increasing_id().alias("node")), "lattice-classes")
    near = components(star_edges(classes.select(F.col("node").alias("id"), F.explode(F.array_distinct("keys")).alias("key"))), "lattice-groups")
    members = classes.join(near, F.col("node") == F.col("id")).select("id", "root", "copies", F.lit(1).alias("weight"))
    vectors_of = classes.select(F.col("node").alias("id"), "vector")
    dealt = blocks(members, rows_per_block, rows_per_block).drop("weight").join(vectors_of, "id")

    def close(left: pa.Table, right: pa.Table) -> np.ndarray:
        return _units(left) @ _units(right).T >= least_cosine

    counts, edges = linked(paired(dealt), close)
    return told(marked, classes, counts, components(edges, "lattice-components")).select(
        "id", "n_links", F.col("class_id").alias("component_id"), "kept"
    )


def _units(rows: pa.Table) -> np.ndarray:
    vectors = rows.column("vector").combine_chunks()
    x = vectors.flatten().to_numpy().reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
