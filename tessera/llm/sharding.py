"""Minimax contiguous sharding of documents (native DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import documents, numbered, written


def shard_documents(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", row_overhead: int = 8, cells: int = 1 << 14
) -> DataFrame:
    """Cut ``docs`` into ``n_shards`` contiguous runs of atomic groups so that the largest shard is as small as it can be.

    Law: ``bytes``. A row weighs the UTF-8 bytes of its text plus ``row_overhead``. All rows of equal texts fall into
    one hash cell; the cells, in order, are the atomic groups. Their sizes (at most ``cells`` numbers, whatever the
    input) are folded in one row: a binary search over the capacity, each candidate checked by a greedy fill, finds
    the smallest capacity that needs no more than ``n_shards`` shards, and the same greedy fill gives the cuts.
    Balance is exact up to one cell, about a ``1/cells`` part of the bytes or the largest set of copies.

    Returns doc_id, size, text_crc32, law, shard, slot (0, 1, ... within a shard, without gaps), grown_shard (null:
    this law has none). A null text counts as an empty one, one of any length as a row. Rows
    that repeat, and those of a null id, keep a slot each. An empty table gives
    no rows. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(row_overhead)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(cells)).cast("int").alias("cell"),
        ),
        "shard-rows",
    )
    owner = cell_shards(rows.groupBy("cell").agg(F.sum("size").alias("bytes")), n_shards)
    placed = rows.join(F.broadcast(owner), "cell")
    out = numbered(placed, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def cell_shards(cells: DataFrame, n_shards: int) -> DataFrame:
    """(cell, shard) from (cell, bytes): minimax contiguous partition, folded in a single row of bounded arrays."""
    # coalesce(1) between the steps of this one row keeps the optimizer from putting one fold inside the next.
    one = cells.agg(F.sort_array(F.collect_list(F.struct("cell", "bytes"))).alias("groups"))
    one = one.select("groups", F.transform("groups", lambda g: g["bytes"]).alias("sizes")).coalesce(1)
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s)

    def shards_needed(capacity):
        start = F.struct(F.lit(1).alias("shards"), F.lit(0).cast("long").alias("load"))
        fill = lambda a, s: F.when(
            a["load"] + s <= capacity, F.struct(a["shards"].alias("shards"), (a["load"] + s).alias("load"))
        ).otherwise(F.struct((a["shards"] + 1).alias("shards"), s.alias("load")))
        return F.aggregate("sizes", start, fill)["shards"]

    def halve(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("long")
        narrowed = F.transform(
            F.array(mid),
            lambda m: F.when(shards_needed(m) <= n_shards, F.struct(a["lo"].alias("lo"), m.alias("hi"))).otherwise(
                F.struct((m + 1).alias("lo"), a["hi"].alias("hi"))
            ),
        )
        return F.when(a["lo"] < a["hi"], narrowed[0]).otherwise(a)

    lowest = F.greatest(F.coalesce(F.array_max("sizes"), F.lit(0).cast("long")), F.ceil(F.col("total") / n_shards).cast("long"))
    one = one.withColumn("total", total).coalesce(1)
    one = one.withColumn("range", F.struct(lowest.alias("lo"), F.greatest("total", lowest).alias("hi")))
    one = one.withColumn("capacity", F.aggregate(F.sequence(F.lit(1), F.lit(62)), F.col("range"), halve)["lo"]).coalesce(1)

    def cut(a, g):
        fits = a["load"] + g["bytes"] <= F.col("capacity")
        return F.when(fits, F.struct((a["load"] + g["bytes"]).alias("load"), a["cuts"].alias("cuts"))).otherwise(
            F.struct(g["bytes"].alias("load"), F.concat(a["cuts"], F.array(g["cell"])).alias("cuts"))
        )

    start = F.struct(F.lit(0).cast("long").alias("load"), F.array().cast("array<int>").alias("cuts"))
    one = one.withColumn("cuts", F.aggregate("groups", start, cut)["cuts"]).coalesce(1)
    return one.select("cuts", F.explode("groups.cell").alias("cell")).select(
        "cell", F.size(F.filter("cuts", lambda c: c <= F.col("cell"))).alias("shard")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
