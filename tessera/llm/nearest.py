"""Approximate nearest neighbours by cross-polytope hashing: pseudo-rotations, multiprobe tables, exact ranking of what they collect."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import joined_to_copies, written


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, orthonormal; the number of columns is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


class Polytopes:
    """``tables`` hash functions of unit vectors of ``dim`` components into ``cells`` cells each, a power of two.

    A vector gets one more component, is padded to a power of two and turned by three rounds of random signs and Hadamard
    transforms. The nearest signed axis among the first d axes is a digit of 2 d values; as many digits follow as the
    cells need, each of a turn of its own, the last one over fewer axes.
    """

    def __init__(self, dim: int, cells: int, tables: int, seed: int) -> None:
        self.dim, self.tables, self.width = dim, tables, 1 << max(1, dim).bit_length()
        bits = max(1, int(cells).bit_length() - 1)
        most = self.width.bit_length()
        self.axes = [1 << (min(most, bits - at) - 1) for at in range(0, bits, most)]
        self.cells = 1 << bits
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, len(self.axes), 3, self.width))

    def sides(self, unit: np.ndarray, tables: range | None = None) -> Iterator[list[np.ndarray]]:
        """For each of ``tables`` (all) the products of each row of ``unit`` (n, dim + 1) with the signed axes of each digit, in units of
        how large the greatest is expected to be, which makes digits of many and of few axes comparable.
        """
        padded = np.zeros((len(unit), self.width))
        padded[:, : unit.shape[1]] = unit
        for signs in self.signs if tables is None else self.signs[tables.start : tables.stop]:
            digits = []
            for axes, three in zip(self.axes, signs):
                y = padded
                for sign in three:
                    y = hadamard(y * sign)
                y = y[:, :axes] * (np.sqrt(self.width) * np.sqrt(2 * np.log(2 * axes)))
                digits.append(np.concatenate([y, -y], axis=1))
            yield digits

    def homes(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each row in each table, numbered through all tables."""
        found = np.zeros((len(unit), self.tables), np.int64)
        for t, digits in enumerate(self.sides(unit)):
            for side in digits:
                found[:, t] = found[:, t] * side.shape[1] + side.argmax(axis=1)
            found[:, t] += t * self.cells
        return found

    def probes(self, unit: np.ndarray, most: int, tables: range, at_once: int = 1 << 22) -> np.ndarray:
        """The ``most`` cells of each of ``tables`` (all, if it has fewer) with the greatest sums of products over their digits.

        Digits are added one by one; only the ``most`` best beginnings can lead to the ``most`` best sums.
        """
        parts = []
        rows = max(1, at_once // (max(1, most) * 2 * max(self.axes)))
        for at in range(0, len(unit), rows):
            found = []
            for t, digits in zip(tables, self.sides(unit[at : at + rows], tables)):
                total, cell = np.zeros((len(digits[0]), 1)), np.zeros((len(digits[0]), 1), np.int64)
                for side in digits:
                    total = (total[:, :, None] + side[:, None, :]).reshape(len(side), -1)
                    cell = (cell[:, :, None] * side.shape[1] + np.arange(side.shape[1])).reshape(len(side), -1)
                    if total.shape[1] > most:
                        best = np.argpartition(-total, most - 1, axis=1)[:, :most]
                        total, cell = np.take_along_axis(total, best, 1), np.take_along_axis(cell, best, 1)
                found.append(cell + t * self.cells)
            parts.append(np.concatenate(found, axis=1))
        return np.concatenate(parts) if parts else np.zeros((0, 0), np.int64)

    def ranks(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells a query, the only row of ``unit``, probes at the least in each table before it comes to each row of ``cells``:
        the smallest number over the tables.
        """
        best = np.full(len(cells), self.cells, np.int64)
        for t, digits in enumerate(self.sides(unit)):
            total = np.zeros(1)
            for side in digits:
                total = (total[:, None] + side[0]).ravel()
            best = np.minimum(best, np.searchsorted(np.sort(-total), -total[cells[:, t] - t * self.cells], side="right"))
        return best


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _unit(x: np.ndarray, largest: float) -> np.ndarray:
    """Rows scaled by ``largest``, the greatest length of any, and completed to length 1 by one more component; then the
    nearest in angle to a query are those of the largest inner product with it.
    """
    x = x / largest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
    return np.column_stack([x, rest])


def _direction(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.column_stack([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros(len(x))])


def by_dimension(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each number of components, and their matrix."""
    sizes = np.diff(vectors.offsets.to_numpy())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, _matrix(vectors.take(pa.array(at)))


def best_of(queries: np.ndarray, rows: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``most`` rows of the largest inner product with each query, ties by ``first``.

    A product of matrices finds them, with a few more for its rounding; then each score is summed component by component,
    so that it is the same wherever a pair meets.
    """
    score = queries @ rows.T
    spare = most + 4
    if score.shape[1] > spare:
        least = np.partition(score, score.shape[1] - spare, axis=1)[:, -spare]
        q, v = np.nonzero(score >= least[:, None])
    else:
        q, v = (a.ravel() for a in np.indices(score.shape))
    exact = np.cumsum(queries[q] * rows[v], axis=1)[:, -1]
    order = np.lexsort([first[v], -exact, q])
    q, v, exact = q[order], v[order], exact[order]
    begins = np.searchsorted(q, np.arange(len(queries)))
    kept = np.arange(len(q)) - begins[q] < most
    return q[kept], v[kept], exact[kept]


def vector_classes(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, print, asks) of the rows that take part, and one row for each different vector: print, copies, ids (its
    ``most`` smallest, in order), vector, its length, asks (whether a query has it), node.
    """
    vector = F.col(vector_col).cast("array<double>")
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & fit).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), is_query.alias("asks"))

    def printed(batches):
        for batch in batches:
            values = batch.column(1)
            ends = values.offsets.to_numpy()
            data = np.ascontiguousarray(values.values.to_numpy() + 0.0)  # -0.0 is 0.0
            prints = [hashlib.blake2b(data[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends, ends[1:])]
            lengths = np.zeros(len(batch))
            for at, x in by_dimension(values):
                greatest = np.abs(x).max(axis=1)
                lengths[at] = greatest * np.sqrt(((x / greatest[:, None]) ** 2).sum(axis=1))
            arrays = [*batch.columns, pa.array(prints, pa.binary()), pa.array(lengths)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "vector", "asks", "print", "length"])

    marked = written(rows.mapInArrow(printed, "id long, vector array<double>, asks boolean, print binary, length double"), "nearest-rows")
    smallest = marked.select("print", "id").distinct().withColumn("at", F.row_number().over(Window.partitionBy("print").orderBy("id"))).where(F.col("at") <= most)
    smallest = smallest.groupBy("print").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = marked.groupBy("print").agg(F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector"), F.max("asks").alias("asks"), F.max("length").alias("length"))
    classes = classes.join(smallest, "print").withColumn("node", F.monotonically_increasing_id())
    return marked.select("id", "print", "asks"), written(classes, "nearest-classes")


class Hashes:
    """The polytopes for vectors of any number of components, made where they are needed."""

    def __init__(self, cells: int, tables: int, seed: int, largest: float) -> None:
        self.cells, self.tables, self.seed, self.largest = cells, tables, seed, largest
        self._made: dict[int, Polytopes] = {}

    def of(self, dim: int) -> Polytopes:
        if dim not in self._made:
            self._made[dim] = Polytopes(dim, self.cells, self.tables, self.seed)
        return self._made[dim]


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def hashes_for(classes: DataFrame, tables: int, rows_per_cell: int, most_cells: int, seed: int) -> Hashes:
    """Hash functions with about one cell of a table for ``rows_per_cell`` vectors."""
    told = classes.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("largest")).first()
    cells = 1 << max(1, min(most_cells, max(1, told["n"] // rows_per_cell)).bit_length())
    return Hashes(cells, tables, seed, min(told["largest"] or 1.0, np.finfo(float).max))


def with_cells(classes: DataFrame, hashes: Hashes) -> DataFrame:
    """``classes`` with the cells that each vector lies in, one of each table."""

    def celled(batches):
        for batch in batches:
            found = np.zeros((len(batch), hashes.tables), np.int64)
            for at, x in by_dimension(batch.column("vector")):
                found[at] = hashes.of(x.shape[1]).homes(_unit(x, hashes.largest))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(found)], names=[*batch.schema.names, "cells"])

    rows = classes.select("print", "copies", "vector", "asks", "ids", "node")
    return rows.mapInArrow(celled, "print binary, copies long, vector array<double>, asks boolean, ids array<long>, node long, cells array<long>")


def probes_for(index: DataFrame, hashes: Hashes, recall: float, sample: int, most: int) -> int:
    """How many cells of each table lead to a share of ``recall`` of the ``most`` nearest of ``sample`` queries, drawn by
    a hash and compared with all rows of ``index``.
    """
    chosen = index.where("asks").orderBy(F.xxhash64("print"), "print").limit(sample).select("node", "vector").collect()
    sizes = {len(r["vector"]) for r in chosen}
    asked_of = {n: np.array([r["node"] for r in chosen if len(r["vector"]) == n]) for n in sizes}
    vectors_of = {n: np.array([r["vector"] for r in chosen if len(r["vector"]) == n]) for n in sizes}

    def compared(batches):
        for batch in batches:
            cells, node = batch.column("cells"), batch.column("node").to_numpy()
            for at, x in by_dimension(batch.column("vector")):
                if (n := x.shape[1]) in sizes:
                    q, v, score = best_of(vectors_of[n], x, node[at], most + 1)
                    arrays = [pa.array(asked_of[n][q]), pa.array(node[at][v]), pa.array(score), cells.take(pa.array(at[v]))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["asked", "node", "score", "cells"])

    near = index.select("node", "vector", "cells").mapInArrow(compared, "asked long, node long, score double, cells array<long>").where("asked != node")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "node"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= most).collect()  # at most ``sample`` x ``most`` rows
    needed = [np.ones(0, np.int64)]
    for r in chosen:
        cells = np.array([n["cells"] for n in near if n["asked"] == r["node"]], np.int64).reshape(-1, hashes.tables)
        needed.append(hashes.of(len(r["vector"])).ranks(_direction(np.array([r["vector"]])), cells))
    needed = np.sort(np.concatenate(needed))
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) if len(needed) else 1


def meet(index: DataFrame, queries: DataFrame, hashes: Hashes, tables: range, probes: int | None, most: int, rows_per_block: int, salts: int = 64) -> DataFrame:
    """(asked, node, ids, score) of the ``most`` best rows of the cells that each of ``queries`` (node, vector, least) probes,
    if their score is ``least`` or more: ``probes`` cells of each of ``tables`` or, for None, all cells of the first, which has
    every row once.

    A row of the index goes to its cells, a query to those it probes. Cells of more rows or queries than ``rows_per_block`` are
    cut into blocks, and each block of rows meets each block of queries: a task holds the rows of one block while queries
    stream past, and sends on the best of each query only.
    """

    def probed(batches):
        for batch in batches:
            for at, x in by_dimension(batch.column("vector")):
                for part in (slice(k, k + 256) for k in range(0, len(at), 256)):
                    if probes is None:
                        keys = np.tile(np.arange(hashes.cells), (len(x[part]), 1))
                    else:
                        keys = hashes.of(x.shape[1]).probes(_direction(x[part]), probes, tables)
                    rows = batch.take(pa.array(at[part]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, _lists(keys)], names=["node", "vector", "least", "cells"])

    asked = queries.select("node", "vector", "least").mapInArrow(probed, "node long, vector array<double>, least double, cells array<long>")
    asked = written(asked, "nearest-probes")
    own = F.slice("cells", tables.start + 1, len(tables))
    rows = index.select(F.size("vector").alias("dim"), F.explode(own).alias("cell"), "node", "vector", "ids", F.lit(None).cast("double").alias("least"))
    nothing = F.lit(None).cast("array<long>").alias("ids")
    asked = asked.select(F.size("vector").alias("dim"), F.explode("cells").alias("cell"), "node", "vector", nothing, "least")

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias(name))

    cut = counted(rows, "row_blocks").join(counted(asked, "query_blocks"), ["dim", "cell"]).where("row_blocks > 1 or query_blocks > 1")
    cut = written(cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "nearest-blocks")

    def placed(df: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        salted = df.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(salts)).cast("int")).join(cut, ["dim", "cell", "salt"], "left")
        block = F.pmod(F.xxhash64("node", F.lit(2)), F.coalesce(own, F.lit(1))).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other)
        return salted.select("dim", "cell", block, every, F.lit(kind).alias("kind"), "node", "vector", "ids", "least")

    keys = ["dim", "cell", "row_blocks", "query_blocks"]
    met = placed(rows, "row_blocks", "query_blocks", 0).unionByName(placed(asked, "query_blocks", "row_blocks", 1))
    return met.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(_meeting(keys, most), FOUND)


FOUND = "asked long, node long, ids array<long>, score double"


def _meeting(keys: list[str], most: int, held_at_most: int = 1 << 18, products: int = 1 << 22):
    def best(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The ``most`` best of each query in ``parts``, a pair that was met twice once."""
        table = pa.Table.from_batches(parts).combine_chunks()
        asked, node, score = (table.column(c).to_numpy() for c in ("asked", "node", "score"))
        ids = table.column("ids").combine_chunks()
        order = np.lexsort([node, ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]], -score, asked])
        asked, node = asked[order], node[order]
        fresh = np.concatenate([[True], (asked[1:] != asked[:-1]) | (node[1:] != node[:-1])])
        order, asked = order[fresh], asked[fresh]
        kept = np.arange(len(asked)) - np.searchsorted(asked, asked) < most
        return table.take(pa.array(order[kept])).to_batches()[0]

    def run(batches):
        now, rows, ready, held, n = None, [], None, [], 0
        for batch in batches:
            values = [batch.column(k).to_numpy() for k in keys]
            kind = batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1), len(batch)]
            for a, b in zip(edges, edges[1:]):
                key = tuple(v[a] for v in values)
                if key != now:
                    now, rows, ready = key, [], None
                cut = a + int((kind[a:b] == 0).sum())
                if cut > a:
                    rows.append(batch.slice(a, cut - a))
                if b > cut and rows:
                    if ready is None:
                        table = pa.Table.from_batches(rows).combine_chunks()
                        ids = table.column("ids").combine_chunks()
                        ready = _matrix(table.column("vector").combine_chunks()), table.column("node").to_numpy(), pa.compute.list_element(ids, 0).to_numpy(), ids
                    x, node, first, ids = ready
                    step = max(1, products // len(x))
                    for at in range(cut, b, step):
                        part = batch.slice(at, min(step, b - at))
                        q, v, score = best_of(_matrix(part.column("vector")), x, first, most)
                        enough = score >= part.column("least").to_numpy(zero_copy_only=False)[q]
                        q, v, score = q[enough], v[enough], score[enough]
                        arrays = [part.column("node").take(pa.array(q)), pa.array(node[v]), ids.take(pa.array(v)), pa.array(score)]
                        held.append(pa.RecordBatch.from_arrays(arrays, names=["asked", "node", "ids", "score"]))
                        n += len(q)
                    if n > held_at_most:
                        held = [best(held)]
                        n = len(held[0])
                        if n > held_at_most // 2:
                            yield held.pop()
                            n = 0
        if n:
            yield best(held)

    return run


def nearest_vectors(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    tables: int = 4,
    recall: float = 0.96,
    rows_per_cell: int = 256,
    most_cells: int = 1 << 20,
    sample: int = 64,
    rows_per_block: int = 4096,
    seed: int = 29,
) -> DataFrame:
    """The ``k`` rows of the largest inner product with each row that ``is_query``, found by cross-polytope hashing.

    Each of ``tables`` tables turns the vectors by pseudo-rotations and numbers the nearest signed axes; a table has about a
    cell for ``rows_per_cell`` different vectors, ``most_cells`` at most (beyond that its cells have more rows). A query
    probes in each table the cells whose axes lie nearest; how many is what leads to a share of ``recall`` of the true neighbours of
    ``sample`` queries, which are compared with all rows. What the first table finds is a bound for the others: only what is as
    near is sent on from them. All that the probed cells hold is compared in double precision,
    summed component by component, in blocks. Lengths may differ: one more component completes each vector to the
    greatest length. A query that finds fewer than ``k`` rows is compared with all of its number of components, in blocks.

    Equal vectors are one row of the index with their ``k`` + 1 smallest ids, which is all that a result can show of them, so
    that copies cost nothing. A query leaves out rows of its own id. Ties go to the smaller id. Null ids, and vectors
    that are null, empty, zero or hold null or non-finite components, take no part; only vectors of as many components are
    compared. A row that repeats an id and its vector counts once; of an id with several vectors each is searched, so that ranks repeat.
    Products beyond double precision are infinite. Fewer rows give fewer neighbours, an empty table an empty result.
    Other columns aren't read. Returns query_id, rank (from 1), id, score.
    """
    most = k + 1
    marked, classes = vector_classes(vectors, id_col, vector_col, is_query, most)
    hashes = hashes_for(classes, tables, rows_per_cell, most_cells, seed)
    index = written(with_cells(classes, hashes), "nearest-index")
    probes = probes_for(index, hashes, recall, sample, most)

    def ranked(found: DataFrame) -> DataFrame:
        """(node, near) with the best (-score, id), ``most`` at most, of each query."""
        rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), F.get("ids", F.lit(0)), "node"))
        found = found.dropDuplicates(["asked", "node"]).withColumn("rank", rank).where(F.col("rank") <= most)
        pairs = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("id")))
        near = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, most)
        return found.groupBy(F.col("asked").alias("node")).agg(near.alias("near"))

    asking = index.where("asks").select("node", "print", "copies", "vector", F.lit(float("-inf")).alias("least"))
    first, others = range(1), range(1, tables)
    found = written(meet(index, asking, hashes, first, probes, most, rows_per_block), "nearest-first")
    if others:
        reached = ranked(found).select("node", F.when(F.size("near") >= most, -F.get("near", F.lit(most - 1))["minus"]).alias("reached"))
        bounded = asking.join(reached, "node", "left").withColumn("least", F.coalesce("reached", "least"))
        found = found.unionByName(meet(index, bounded, hashes, others, probes, most, rows_per_block))
    found = written(ranked(found), "nearest-found")
    short = asking.join(found.where(F.size("near") >= most).select("node"), "node", "left_anti")
    if short.take(1):
        short = written(short, "nearest-short")
        found = found.where(F.size("near") >= most).unionByName(ranked(meet(index, short, hashes, first, None, most, rows_per_block)))
    answers = asking.select("node", "print", "copies").join(found, "node").select("print", "copies", "near")
    ids = marked.where("asks").select("id", "print").distinct()
    near = F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k)
    rows = joined_to_copies(ids, written(answers, "nearest-answers"), "print").select(F.col("id").alias("query_id"), F.posexplode(near).alias("at", "n"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("id"), (-F.col("n.minus")).alias("score"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")
