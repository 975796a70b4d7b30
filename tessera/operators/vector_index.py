"""An inverted file of vectors, cells of k-means centroids that a search reads by partition pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import METRICS, distance, norm
from tessera.operators.retrieval import KEY, SearchFilter

#: What a filter of a search may ask for, kept beside the vectors.
FILTERS = ("collection", "page_type", "source_format", "agent_handle", "memory_type")
#: The cell of rows without a direction: no vector, a zero one, one of another number of components, or not finite.
NOWHERE = -1


class VectorIndex:
    """Rows (key, filter columns, vector) as Parquet partitioned by cell, and the cells' centroids.

    A search ranks the centroids on the driver, which holds ``cells`` of them, and reads the nearest cells only: the scan's
    partition filter names them. ``probes`` of them are enough for the recall that was asked for when the index was made. If these
    hold fewer than k rows that pass the filter, twice as many are read, up to all, so a filter never costs hits. Rows that came
    after the index (``unindexed``) are compared one by one beside it.
    """

    def __init__(self, spark: SparkSession, folder: str, key: tuple[str, ...] = KEY):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        told = spark.read.parquet(f"{self.folder}/centroids").orderBy("cell").collect()
        self.metric, self.probes = told[0]["metric"], told[0]["probes"]
        self.centroids = np.array([r["centroid"] for r in told if r["cell"] != NOWHERE], np.float64)
        self.rows = spark.read.schema(told[0]["schema"]).parquet(f"{self.folder}/vectors")  # a table without rows has no file

    def nearest_cells(self, query: list[float]) -> list[int]:
        """All cells, the nearest first, those of rows without a direction last."""
        if not len(self.centroids) or len(query) != self.centroids.shape[1]:
            return [*range(len(self.centroids)), NOWHERE]
        return [*np.argsort(_far(self.centroids, np.array([query], np.float64), self.metric)[0], kind="stable").tolist(), NOWHERE]

    def search(
        self,
        query: list[float],
        k: int,
        where: SearchFilter = SearchFilter(),
        *,
        metric: str = "cosine",
        probes: int | None = None,
        exact_search: bool = False,
        unindexed: DataFrame | None = None,
    ) -> DataFrame:
        """(key, distance) of the ``k`` nearest rows of the nearest ``probes`` cells, ties by key. With ``exact_search``, of all."""
        if metric != self.metric:
            raise ValueError(f"the index is made for {self.metric}, not for {metric}")
        order = self.nearest_cells(query)
        n = len(order) if exact_search else min(len(order), probes or self.probes)
        while True:
            rows = self.pruned(order[:n]).select(*self.key, *FILTERS, "vector")
            if unindexed is not None:
                rows = rows.unionByName(unindexed.select(*self.key, *FILTERS, "vector"))
            found = rows.where(where.predicate()).select(*self.key, distance(F.col("vector"), query, metric).alias("distance"))
            found = found.orderBy("distance", *self.key).limit(k)
            if n == len(order):
                return found
            hits = found.collect()  # k rows
            if len(hits) == k:
                return self.spark.createDataFrame(hits, found.schema)
            n = min(len(order), 2 * n)

    def pruned(self, cells: list[int]) -> DataFrame:
        return self.rows.where(F.col("cell").isin(cells))


def build_vector_index(
    chunks: DataFrame,
    folder: str,
    metric: str = "cosine",
    cells: int | None = None,
    recall: float = 0.97,
    k: int = 10,
    rows_per_cell_fitted: int = 64,
    most_cells: int = 4096,
    seed: int = 7,
    key: tuple[str, ...] = KEY,
) -> VectorIndex:
    """An index of all rows of ``chunks`` in ``folder``; absent filter columns are null.

    Centroids come from Spark's k-means, fitted on at most ``cells`` x ``rows_per_cell_fitted`` rows drawn by a hash of the key; by
    default there are about as many cells as the root of the rows, ``most_cells`` at most. Every row is then put in the cell of its
    nearest centroid, and written by ranges of (cell, key), so that a crowded cell is several files. ``probes`` is what leads
    to a share of ``recall`` of the ``k`` nearest of 128 rows drawn likewise, which are compared with all.
    """
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    spark = chunks.sparkSession
    have = set(chunks.columns)
    rows = chunks.select(*key, *(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in FILTERS if c not in key), "vector")
    size = F.size("vector")
    dimension = (rows.where(size > 0).groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").first() or {"n": 0})["n"]
    directed = (size == dimension) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (norm(F.col("vector")) > 0)
    there = rows.where(F.coalesce(directed, F.lit(False)))
    n = there.count()
    cells = cells or int(min(most_cells, max(1, round(n**0.5))))
    centroids = _centroids(there, metric, cells, _share(cells * rows_per_cell_fitted, n), seed, key) if n else np.zeros((0, max(1, dimension)))

    @F.pandas_udf("int")
    def cell_of(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
        return pd.Series(_far(centroids, x, metric).argmin(axis=1))

    placed = there.withColumn("cell", cell_of("vector")).unionByName(rows.where(~F.coalesce(directed, F.lit(False))).withColumn("cell", F.lit(NOWHERE)))
    placed.repartitionByRange("cell", *key).sortWithinPartitions("cell", *key).write.partitionBy("cell").parquet(f"{folder}/vectors")
    probes = _probes(spark.read.parquet(f"{folder}/vectors"), centroids, metric, recall, k, seed, key) if n else 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    told = [(NOWHERE, metric, probes, schema, [])] + [(c, metric, probes, schema, v) for c, v in enumerate(centroids.tolist())]
    spark.createDataFrame(told, "cell int, metric string, probes int, schema string, centroid array<double>").write.parquet(f"{folder}/centroids")
    return VectorIndex(spark, folder, key)


def _share(wanted: int, n: int) -> int:
    return int(min(1.0, wanted / max(1, n)) * (1 << 30))


def _drawn(rows: DataFrame, share: int, seed: int, key: tuple[str, ...]) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) < F.lit(share))


def _unit_of(vector: Column, metric: str) -> Column:
    plain = vector.cast("array<double>")
    if metric != "cosine":
        return plain
    return F.transform(F.arrays_zip(plain.alias("x"), F.array_repeat(norm(vector), F.size(vector)).alias("n")), lambda p: p["x"] / p["n"])


def _centroids(rows: DataFrame, metric: str, cells: int, share: int, seed: int, key: tuple[str, ...]) -> np.ndarray:
    drawn = _drawn(rows, share, seed, key).select(array_to_vector(_unit_of(F.col("vector"), metric)).alias("features")).persist()
    try:
        model = KMeans(k=max(2, cells), seed=seed, maxIter=15, distanceMeasure="cosine" if metric == "cosine" else "euclidean").fit(drawn)
        return np.array(model.clusterCenters(), np.float64)[: max(1, cells)] if cells > 1 else np.array(model.clusterCenters(), np.float64).mean(axis=0)[None, :]
    finally:
        drawn.unpersist()


def _far(points: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances (rows of ``x``, ``points``), up to what is the same for all points."""
    if metric == "dot":
        return -(x @ points.T)
    if metric == "l2":
        return (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
    lengths = np.sqrt((points * points).sum(axis=1))
    return -(x @ (points / np.where(lengths > 0, lengths, 1)[:, None]).T)


def _probes(rows: DataFrame, centroids: np.ndarray, metric: str, recall: float, k: int, seed: int, key: tuple[str, ...]) -> int:
    there = rows.where(F.col("cell") != NOWHERE)
    asked = there.orderBy(F.xxhash64(*key, F.lit(seed + 1)), *key).limit(128).select("vector").collect()
    queries = np.array([r["vector"] for r in asked], np.float64)

    def nearest(frames):
        for frame in frames:
            x = np.array(frame["vector"].tolist(), np.float64)
            far = _far(x, queries, metric) if metric != "cosine" else _far(x / np.sqrt((x * x).sum(axis=1))[:, None], queries, metric)
            for q, row in enumerate(far):
                best = np.argsort(row, kind="stable")[:k]
                yield pd.DataFrame({"q": q, "far": row[best], "cell": frame["cell"].to_numpy()[best]})

    near = there.select("vector", "cell").mapInPandas(nearest, "q int, far double, cell int").toPandas()  # k rows a query and batch
    near = near.sort_values(["q", "far", "cell"]).groupby("q").head(k)
    rank = np.argsort(np.argsort(_far(centroids, queries, metric), axis=1, kind="stable"), axis=1)
    needed = np.sort(rank[near["q"], near["cell"]]) + 1
    return int(needed[int(np.ceil(recall * len(needed))) - 1])
