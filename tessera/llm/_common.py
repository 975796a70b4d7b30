"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the session names none, a local session gets a temporary folder; on a cluster that would be a folder of each
    machine's own, so it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts lineage: what follows survives a lost executor without running ``df`` again, and several readers
    see the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_and_told(df: DataFrame, name: str, *told: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates of its rows, which are taken while they are written, without a job of their own."""
    seen = Observation()
    return written(df.observe(seen, *told), name), seen.get


def numbered(df: DataFrame, group: str, order: list[Column], name: str, salts: int = 1024) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... within each value of ``group``, however many rows a value has.

    Rows of a group are dealt over ``salts`` hash slots; the counts per (group, slot) give each slot its first
    number, and ``row_number`` runs inside a slot only. So no task ever holds a whole group. ``group`` must have few
    distinct values (a shard, a length): the table of counts has at most values x ``salts`` rows, which bounds what
    is broadcast.
    """
    salted = df.withColumn("_slot", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy("_group").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        salted.groupBy(F.col(group).alias("_group"), "_slot")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_group", F.col("_slot").alias("_slot2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy(group, "_slot").orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(first), (F.col(group) == F.col("_group")) & (F.col("_slot") == F.col("_slot2")))
        .withColumn(name, (F.col("_first") + F.col("_rank") - 1).cast("long"))
        .drop("_slot", "_slot2", "_group", "_first", "_rank")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def drawn(rows: DataFrame, at_most: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """About ``at_most`` rows of ``rows``, the same in every run, chosen by a hash of ``id_col``; all if there are fewer."""
    share = min(1.0, at_most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def joined_to_copies(rows: DataFrame, classes: DataFrame, key: str, copies: str = "copies", shares: int = 1000) -> DataFrame:
    """``rows`` joined to ``classes`` (one row for each ``key``, with how many rows have it in ``copies``).

    A key of more than a ``shares``-th of all rows is dealt over as many salts as it has such shares. There are at most
    twice ``shares`` such keys, so that what is broadcast has a bound at every size.
    """
    total = classes.agg(F.sum(copies)).first()[0] or 0
    share = F.lit(max(1, int(total) // shares))
    dealt = classes.withColumn("_salts", F.ceil(F.col(copies) / share).cast("int"))
    hot = dealt.where("_salts > 1").select(key, F.col("_salts").alias("_of"))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_of", F.lit(1))).cast("int")
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_of")
    spread = dealt.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return salted.join(spread, [key, "_salt"]).drop("_salt")
