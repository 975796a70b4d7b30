"""Connected components, and comparison of all members of a cluster without a row for each pair."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import written, written_and_told


def star_edges(members: DataFrame) -> DataFrame:
    """Edges (a, b) from each member of a bucket to its smallest: ``members`` has (key, id). A bucket of n distinct ids
    gives n - 1 edges. Buckets of one id fall away before the join.
    """
    shared = members.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("top")).where(F.col("b") < F.col("top"))
    return members.join(shared, "key").where(F.col("id") > F.col("b")).select(F.col("id").alias("a"), "b").distinct()


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b), root being the smallest id that edges lead to.

    Rounds of large-star and small-star steps, each a grouped minimum and a join, so that a hub is never gathered in
    one task; every round is written to the shared folder, which cuts lineage. It ends when a round changes nothing.
    """
    told = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, state = written_and_told(edges, name, *told)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_lowest(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where(F.col("a") != F.col("b"))
        before = state
        now, state = written_and_told(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), name, *told)
        if state == before:
            break
    else:
        raise RuntimeError(f"components of {name} did not settle in {most_rounds} rounds")
    member = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    return member.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _with_lowest(edges: DataFrame, salts: int = 32) -> DataFrame:
    """``edges`` (a, b) with low, the smallest b of the same a. What a hub leads to is split over ``salts`` keys."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("low"))
    lowest = parts.groupBy("a").agg(F.min("low").alias("low"))
    return salted.join(parts.select("a", "salt").join(lowest, "a"), ["a", "salt"]).drop("salt")


def told(marked: DataFrame, classes: DataFrame, counts: DataFrame, found: DataFrame, *more: str) -> DataFrame:
    """id, rep, class_id, n_links, kept, and ``more`` of its columns, of each row of ``marked`` (id, print).

    ``classes`` (print, node, rep, copies) has one row for each different content; counts of links (id, links) and roots
    (id, root) are of nodes and joined to it, so that the rows are joined once.
    """
    zero = F.lit(0).cast("long")
    known = classes.select("print", "node", "rep", "copies").join(counts.withColumnRenamed("id", "counted"), F.col("node") == F.col("counted"), "left")
    known = known.join(found.withColumnRenamed("id", "member"), F.col("node") == F.col("member"), "left")
    smallest = classes.join(found, F.col("node") == F.col("id")).groupBy("root").agg(F.min("rep").alias("class"))
    known = known.join(smallest, "root", "left")
    known = known.select("print", "rep", F.coalesce("class", "rep").alias("class"), (F.coalesce("links", zero) + F.col("copies") - 1).alias("n_links"))
    owner = F.coalesce("class", "id")
    return (
        marked.select("id", "print", *more)
        .join(known, "print", "left")
        .select(
            "id", F.coalesce("rep", "id").alias("rep"), owner.alias("class_id"), F.coalesce("n_links", zero).alias("n_links"),
            F.col("id").eqNullSafe(owner).alias("kept"), *more,
        )
    )


def blocks(members: DataFrame, rows_per_block: int, weight_per_block: int, salts: int = 64) -> DataFrame:
    """``members`` (id, root, weight, ...) with n_blocks and block: a group is cut into blocks by a hash of id.

    Rows here are small; what the comparison reads is joined to them by id afterwards, so that it is never shuffled by
    group. Groups of more than one block meet their size over ``salts`` keys, so no task reads a whole large group.
    """
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(salts)).cast("int"))
    wanted = F.greatest(F.ceil(F.count(F.lit(1)) / rows_per_block), F.ceil(F.sum("weight") / weight_per_block)).cast("int")
    large = members.groupBy("root").agg(wanted.alias("n_blocks")).where(F.col("n_blocks") > 1)
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    n_blocks = F.coalesce("n_blocks", F.lit(1))
    dealt = salted.join(large, ["root", "salt"], "left").withColumn("n_blocks", n_blocks).drop("salt")
    return dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))


def paired(dealt: DataFrame) -> DataFrame:
    """``dealt`` (with block, n_blocks) with p and q: a row goes to each pair of blocks that its own block is in. A group
    of one block gives each row once.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    dealt = dealt.select("*", other.alias("other"))
    return dealt.select("*", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")).drop("other", "n_blocks")


def by_group(df: DataFrame, keys: list[str], found: Callable[[pa.Table], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """What ``found`` gives for the rows of each value of ``keys`` (whole numbers), many small groups to a batch."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(table: pa.Table, last: bool):
        values = [table.column(k).to_numpy() for k in keys]
        edges = [0, *(np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1), len(table)] if len(table) else [0]
        held = len(table) if last or len(edges) < 2 else edges[-2]
        made = [found(table.slice(a, b - a)) for a, b in zip(edges, edges[1:]) if b <= held]
        columns = {n: np.concatenate([m[n] for m in made]) if made else [] for n in names}
        return columns if made else None, table.slice(held)

    def run(batches):
        left = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            columns, left = each(pa.concat_tables([left, now]) if left is not None and len(left) else now, False)
            if columns:
                yield pa.RecordBatch.from_pydict(columns)
        if left is not None and len(left):
            columns, _ = each(left, True)
            yield pa.RecordBatch.from_pydict(columns)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def linked(dealt: DataFrame, matches: Callable[[pa.Table, pa.Table], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """(id, links) and edges (a, b) of links that keep what is connected connected, from ``paired``.

    ``matches(left, right)`` says for each pair of rows of two tables whether they link. Each pair of blocks is one
    call and gives at most one edge for each row, and for each row the copies (column ``copies``) it links to there.
    """

    def compare(rows: pa.Table) -> dict[str, np.ndarray]:
        p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        block, ids, copies = (rows.column(c).to_numpy() for c in ("block", "id", "copies"))
        order = np.lexsort([ids, block])
        rows, ids, copies = rows.take(order), ids[order], copies[order]
        if p == q:
            hit = matches(rows, rows)
            np.fill_diagonal(hit, False)
        else:
            cut = int((block == p).sum())
            hit = np.zeros((len(ids), len(ids)), bool)
            hit[:cut, cut:] = matches(rows.slice(0, cut), rows.slice(cut))
            hit |= hit.T
        counts = hit @ copies
        low = ids.copy()
        while len(ids):
            lower = np.minimum(low, np.where(hit, low[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (lower == low).all():
                break
            low = lower
        some = counts > 0
        return {"id": ids[some], "links": counts[some].astype(np.int64), "low": low[some]}

    found = written(by_group(dealt, ["root", "p", "q"], compare, "id long, links long, low long"), "links")
    edges = found.where(F.col("low") < F.col("id")).select(F.col("id").alias("a"), F.col("low").alias("b"))
    return found.groupBy("id").agg(F.sum("links").alias("links")), edges
