"""Centroid clustering by weighted deduplication: Lloyd's rounds run on distinct quantised vectors with multiplicities."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import joined_to_copies, written

#: Quantised components are kept within this, so that the square of a distance is a long whatever the dimension up to 128.
WIDEST = 1 << 27


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dimension: int, scale: int) -> DataFrame:
    """(id, key) of the vectors that have ``dimension`` components, none null or non-finite: key has floor(scale * x) of
    each component as 32-bit numbers, held within -``WIDEST`` and ``WIDEST``.
    """
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where((F.size(vector) == dimension) & finite).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))

    def floored(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(len(batch), dimension)
            key = np.clip(np.floor(np.clip(x, -WIDEST, WIDEST) * scale), -WIDEST, WIDEST).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(key)], names=["id", "key"])

    return rows.mapInArrow(floored, "id long, key binary")


def _binary(key: np.ndarray) -> pa.Array:
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(key.shape[1] * 4), len(key), [None, pa.py_buffer(np.ascontiguousarray(key))])
    return fixed.cast(pa.binary())


def _numbers(keys: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), "<i4").reshape(len(keys), dimension).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest number of a nearest centroid of each row, and its squared distance, in exact whole numbers."""
    distance = np.empty((len(x), len(centroids)), np.int64)
    for k, centroid in enumerate(centroids):
        off = x - centroid
        distance[:, k] = np.einsum("ij,ij->i", off, off)
    number = distance.argmin(axis=1)
    return number, distance[np.arange(len(x)), number]


def seeds(rows: DataFrame, clusters: int, salt: str, dimension: int) -> np.ndarray:
    """The vectors of the ``clusters`` smallest SHA-256 of ``salt:id``, in the order of the hashes."""
    hashed = rows.where(F.col("id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).alias("hash"), "key")
    chosen = hashed.orderBy("hash", "key").limit(clusters).collect()
    return _numbers(pa.array([bytes(r["key"]) for r in chosen], pa.binary()), dimension)


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = 8,
    rounds: int = 10,
    dimension: int = 64,
    scale: int = 1024,
    salt: str = "3",
) -> DataFrame:
    """Clusters of the vectors of exactly ``dimension`` components, none null or non-finite, by ``rounds`` of Lloyd in whole numbers.

    A component x counts as floor(``scale`` * x). Equal quantised vectors are one row with a multiplicity, and every round
    reads these rows only: a task assigns its rows to the nearest centroid (squared Euclidean distance; ties: the smaller
    number) and sends for each centroid one row of weighted sums; a non-empty centroid becomes the floor of sum / count
    by component, an empty one stays. Then the rows are assigned once more and joined to the ids, split where a vector
    has many. Centroids (``clusters`` x ``dimension`` numbers) are all that comes to the driver.

    The first centroids are the vectors of the smallest SHA-256 of ``salt:id``, ties by the quantised bytes; fewer vectors
    than ``clusters`` give as many centroids. Components beyond ``WIDEST`` count as that. Rows of a null id take part
    but give no first centroid; if all ids are null there is none and the result is empty. Rows that repeat an id are rows
    of their own. An empty table gives an empty one; other columns aren't read.
    Returns id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, id_col, vector_col, dimension, scale), "centroids-rows")
    classes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")), "centroids-classes")
    centroids = seeds(rows, clusters, salt, dimension)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def summed(batches):
        total = np.zeros((len(centroids), dimension), np.int64)
        count = np.zeros(len(centroids), np.int64)
        for batch in batches:
            x, copies = _numbers(batch.column(0), dimension), batch.column(1).to_numpy()
            number, _ = nearest(x, centroids)
            np.add.at(count, number, copies)
            for k in np.unique(number):
                total[k] += copies[number == k] @ x[number == k]
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": at.astype(np.int32), "count": count[at], "total": pa.array(total[at].tolist(), pa.list_(pa.int64()))})

    for _ in range(rounds):
        parts = classes.mapInArrow(summed, "cluster int, count long, total array<long>")
        sums = parts.groupBy("cluster").agg(F.sum("count").alias("count"), *(F.sum(F.get("total", F.lit(k))).alias(f"x{k}") for k in range(dimension)))
        centroids = centroids.copy()
        for row in sums.collect():  # at most one row for each cluster
            centroids[row["cluster"]] = [row[f"x{k}"] // row["count"] for k in range(dimension)]

    def assigned(batches):
        for batch in batches:
            number, distance = nearest(_numbers(batch.column(0), dimension), centroids)
            arrays = [batch.column(0), batch.column(1), pa.array(number, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "copies", "cluster", "distance"])

    told = written(classes.mapInArrow(assigned, "key binary, copies long, cluster int, distance long"), "centroids-assigned")
    weight = F.sum(F.col("distance").cast("decimal(19,0)") * F.col("copies"))
    by_cluster = {r["cluster"]: int(r["w"]) for r in told.groupBy("cluster").agg(weight.alias("w")).collect()}  # one row for each cluster
    most, whole = (1 << 63) - 1, sum(by_cluster.values())
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of_cluster = [(k, min(w, most), min(whole, most), digest[k]) for k, w in sorted(by_cluster.items())]
    of_cluster = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = joined_to_copies(rows, told, "key").select("id", "cluster", "distance")
    return found.join(F.broadcast(of_cluster), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def _lloyd_sql(rounds: int) -> str:
    """The rounds one after another; ``a<r>`` are the assignments to ``c<r>``."""
    distance = "list_sum(list_transform(list_zip(k.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
    SELECT vec_id, v, unnest(best) FROM (
        SELECT k.vec_id, any_value(k.v) AS v, min({{'distance': CAST({distance} AS BIGINT), 'cluster': c.cluster}}) AS best FROM kept k, c{r} c GROUP BY k.row, k.vec_id
    )
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(n.c, c.c) AS c FROM c{r} c LEFT JOIN (
        SELECT cluster, list(m ORDER BY i) AS c FROM (
            SELECT cluster, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i
        ) GROUP BY cluster
    ) n USING (cluster)
)""")
    return ",\n".join(steps)


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8
), {_lloyd_sql(10)}
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a10 a JOIN c10 c USING (cluster)"""
