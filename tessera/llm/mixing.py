"""Mixing sources to target weights by a low-discrepancy schedule (native DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import WORD, documents, written

#: Bits of a van der Corput point that say whose slot it is; a source has one unit of 2^-32 at least.
BITS = 32


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3 and again; their shares of all words stop at ``max_repeats``
    times their size, and what is above goes to the others by weight. That fixed point is a water level: with the
    sources in order of cap / weight, (words left) / (weight left) rises over the capped ones and falls from there on,
    so the level is its maximum.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn(
        "cap", (F.col("source_size") * max_repeats).cast("double")
    )
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", left / F.sum("weight").over(rest))
    level = F.coalesce(F.max("level").over(everything), F.lit(0.0))
    return levels.select(
        "source", "source_size", "weight", F.least("cap", F.col("weight") * level).alias("target")
    )


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = 512,
    max_repeats: int = 3,
    slot_chunk: int = 1 << 16,
) -> DataFrame:
    """How many words of each document a mix of all sources takes, and at which slots of the schedule.

    Each source's documents, shuffled by a hash of their id, form one stream cut into blocks of ``block_words`` words.
    Slot i of the schedule has the point i of the van der Corput sequence; the cumulative shares of the sources say
    whose slot it is, and its rank among that source's slots which block it takes, round after round. A source's last
    slot is cut so that the source gives its target to the word. Any prefix of the schedule has near the target
    shares. Each source's slots are enumerated on their own, so a small source costs no more points than it has slots.

    Prefix sums run over hash buckets of a source (4096), so that a source with a third of all rows is spread. Returns
    doc_id, size, source, source_size, target, taken, and slots: in rising order those that take the document's first
    block of words, one for each round in which it gives any (at most ``max_repeats``). Null texts and those without
    words have size 0 and give nothing; a null source is a source; documents of one id follow each other by size; null
    ids are shuffled by their text; rows that repeat count as often as they stand. A document of any length is cut over
    its blocks. An empty table gives an empty one. Columns but id, text and source aren't read.
    """
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(""))).alias("key"),
        ),
        "mix-rows",
    ).withColumn("bucket", F.substring("key", 1, 3))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    plan = written(source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), max_repeats), "mix-sources")
    quota = plan.select(
        "source", "source_size", "target", F.least(F.round("target").cast("long"), F.col("source_size") * max_repeats).alias("quota")
    )
    segments = _segments(rows, buckets, block_words)
    taken = segments.join(
        _slots(quota, block_words, slot_chunk).withColumnRenamed("source", "slot_source").hint("merge"),  # they grow with the words
        F.col("source").eqNullSafe(F.col("slot_source")) & (F.col("block") == F.col("slot_block")),
        "left",
    )
    none = F.lit(0).cast("long")  # a block without a slot gives nothing
    overlap = F.greatest(F.least(F.col("upto"), F.coalesce("cap", none)) - F.col("since"), none)
    own = F.when((F.col("block") == F.col("first_block")) & (overlap > 0), F.col("slot"))  # a round or none for each
    taken = taken.groupBy("source", "bucket", "rank", "doc_id", "size").agg(F.sum(overlap).alias("taken"), F.sort_array(F.collect_list(own)).alias("slots"))
    told = quota.select(F.col("source").alias("own"), "source_size", "target")
    return taken.join(told, F.col("source").eqNullSafe(F.col("own"))).select(
        "doc_id", "size", "source", "source_size", "target", "taken", "slots"
    )


def _segments(rows: DataFrame, buckets: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document has words in: from word ``since`` to word ``upto`` of the block."""
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(
        F.col("source").alias("own"), F.col("bucket").alias("own_bucket"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    placed = (
        rows.withColumn("rank", F.row_number().over(inside))
        .withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, F.col("source").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("own_bucket")))
        .withColumn("start", F.col("base") + F.col("end") - F.col("size"))
        .select("doc_id", "source", "bucket", "rank", "size", "start", (F.col("base") + F.col("end")).alias("end"))
    )
    size = F.lit(block_words).cast("long")
    first, last = F.floor(F.col("start") / size), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / size)
    cut = placed.withColumn("first_block", first).withColumn("block", F.explode(F.sequence(first, last)))
    return cut.select(
        "doc_id", "source", "bucket", "rank", "size", "block", "first_block",
        F.greatest(F.col("start") - F.col("block") * size, F.lit(0).cast("long")).alias("since"),
        F.least(F.col("end") - F.col("block") * size, size).alias("upto"),
    )


def _runs(low: Column, high: Column) -> Column:
    """The indexes of the van der Corput points in [low, high) / 2^BITS, as an array of (every, since): since + k x every.

    The interval is a union of at most two dyadic intervals of each size; an index whose point lies in one has the bits
    of the interval's place, in reverse, as its last bits.
    """

    def at_level(b: Column) -> Column:
        size = F.pow(F.lit(2.0), b)
        l, h = F.ceil(low / size), F.floor(high / size)  # noqa: E741
        above, below = F.ceil(low / (size * 2)), F.floor(high / (size * 2))
        depth = F.lit(BITS) - b.cast("int")
        since = lambda v: F.conv(F.reverse(F.lpad(F.bin(v), depth, F.lit("0"))), 2, 10).cast("long")
        run = lambda v: F.struct(F.pow(F.lit(2.0), depth).cast("long").alias("every"), F.coalesce(since(v), F.lit(0).cast("long")).alias("since"))
        half = lambda v: F.floor(v / 2)
        alone = F.filter(F.array_distinct(F.array(l, h - 1)), lambda v: (v >= l) & (v < h) & ~((half(v) >= above) & (half(v) < below)))
        return F.transform(alone, run)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BITS)), at_level))


def _slots(quota: DataFrame, block_words: int, slot_chunk: int) -> DataFrame:
    """(source, slot_block, slot, cap): the slots of the schedule that the quotas let stand, and the words each may take.

    A slot's rank among its source's is a sum over the source's runs, so nothing is sorted or numbered.
    """
    size = F.lit(block_words).cast("long")
    plan = (
        quota.where(F.col("quota") > 0)
        .withColumn("blocks", F.ceil(F.col("source_size") / size))
        .withColumn("rounds", F.floor(F.col("quota") / F.col("source_size")))
        .withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil((F.col("quota") - F.col("rounds") * F.col("source_size")) / size))
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("target") / F.sum("target").over(everything)
    width = F.greatest(F.floor(share * (F.lit(1 << BITS) - F.count(F.lit(1)).over(everything))), F.lit(1)).cast("long")
    plan = plan.withColumn("width", width).withColumn("high", F.sum("width").over(ordered))
    plan = plan.withColumn("runs", _runs(F.col("high") - F.col("width"), F.col("high")))
    # The points of a source among the first n are n x width / 2^BITS but for one a run.
    upto = F.ceil((F.col("slots") + F.size("runs")) / F.col("width") * float(1 << BITS))
    cut = plan.withColumn("upto", upto).withColumn("run", F.explode("runs"))
    n = F.greatest(F.ceil((F.col("upto") - F.col("run.since")) / F.col("run.every")), F.lit(0))
    cut = cut.withColumn("n", n).where("n > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / slot_chunk))))
    cut = cut.repartition("source", "run", "chunk")
    last = F.least(F.col("n"), (F.col("chunk") + 1) * slot_chunk) - 1
    cut = cut.withColumn("k", F.explode(F.sequence(F.col("chunk") * slot_chunk, last)))
    cut = cut.withColumn("slot", F.col("run.since") + F.col("k") * F.col("run.every"))
    earlier = lambda total, r: total + F.greatest(F.ceil((F.col("slot") - r["since"]) / r["every"]), F.lit(0))
    cut = cut.withColumn("place", F.aggregate("runs", F.lit(0).cast("long"), earlier)).where(F.col("place") < F.col("slots"))
    block = F.col("place") % F.col("blocks")
    before = F.floor(F.col("place") / F.col("blocks")) * F.col("source_size") + block * size
    return cut.select("source", block.alias("slot_block"), "slot", F.least(size, F.col("quota") - before).alias("cap"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"))


OP8_SQL = """
WITH RECURSIVE sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
    FROM sized GROUP BY source
), levels AS (
    SELECT *, 3.0::DOUBLE * source_size AS cap,
           (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (
                ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (
                ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources
), targets AS (
    SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM levels)) AS target FROM levels
), quotas AS (
    SELECT *, least(CAST(round(target) AS BIGINT), 3 * source_size) AS quota FROM targets
), placed AS (
    SELECT doc_id, source, size,
           sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
    FROM sized
), widths AS (
    SELECT source, CAST(greatest(floor(target / sum(target) OVER () * (4294967296 - count(*) OVER ())), 1) AS BIGINT) AS width,
           (quota // source_size) * ceil(source_size / 512.0) + ceil((quota % source_size) / 512.0) AS slots
    FROM quotas WHERE quota > 0
), intervals AS (
    SELECT *, sum(width) OVER (ORDER BY source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM widths
), points AS (
    SELECT i AS slot, list_sum([((i >> k) & 1) << (31 - k) for k in range(32)]) AS point
    FROM range((SELECT CAST(max((slots + 64) * 4294967296 / width) AS BIGINT) FROM widths)) t(i)
), ranked AS (
    SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS place
    FROM points JOIN intervals ON point >= high - width AND point < high
), taking AS (
    SELECT doc_id, p.source, size, source_size, target, start,
           CAST(CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size
                + greatest(0, least(start + size, quota % source_size) - start) END AS BIGINT) AS taken
    FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, taken, CAST(CASE WHEN taken > 0 THEN slot END AS BIGINT) AS first_slot
FROM taking t LEFT JOIN ranked r ON t.source IS NOT DISTINCT FROM r.source AND t.start // 512 = r.place
"""


def repeat_by_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with their own columns, as often as the mix takes their words, to the nearest whole number,
    in the order of the schedule: a repetition stands at the slot of its round.

    Documents that the mix leaves, and those without words, are left out. Rows that share a doc_id, null ones too, share
    the mean of its counts. Any other columns may be there.
    """
    mixed = mix_documents(docs, **options).groupBy(F.col("doc_id").alias("id"))
    times = F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int")
    mixed = mixed.agg(times.alias("times"), F.min_by("slots", F.get("slots", F.lit(0))).alias("slots")).where("times > 0")
    joined = docs.select(F.struct("*").alias("row")).join(mixed, F.col("row.doc_id").eqNullSafe(F.col("id")))
    turns = joined.select("row", "slots", F.explode(F.sequence(F.lit(1), "times")).alias("turn"))
    at = F.get("slots", F.least(F.col("turn"), F.size("slots")) - 1)
    placed = turns.select("row", at.alias("at"), "turn").repartitionByRange("at", "row.doc_id").sortWithinPartitions("at", "row.doc_id", "turn")
    return placed.select("row.*")
