"""Chat formatting by perspective rotation: every participant once as the assistant (native DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import written

ASSISTANT = "<|assistant|>\n"


def escaped(text: Column, name: bool = False) -> Column:
    """``text`` with a backslash put into what reads as the start of a mark, ``<|``, also where backslashes are in it
    already, so that taking one out gives the text again; in a name ``|>`` likewise.
    """
    text = F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")
    return F.regexp_replace(text, r"\|(\\*)>", r"|\\$1>") if name else text


def _said(turns: DataFrame, conv_col: str, turn_col: str, speaker_col: str, text_col: str) -> DataFrame:
    return turns.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("said"),
    )


def _placed(rows: DataFrame, rows_per_part: int, order: list[str]) -> DataFrame:
    """``rows`` (conv, turn, slot, ...) with ``part``: their position in the dialogue by turn, slot and ``order``, in parts
    of ``rows_per_part``. Positions come from counts of (turn, slot), so no task ranks a whole dialogue.
    """
    cells = rows.groupBy("conv", "turn", "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.floor(F.col("turn") / rows_per_part))
    buckets = cells.groupBy("conv", "bucket").agg(F.sum("n").alias("n"))
    earlier = lambda group, order: Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda window: F.coalesce(F.sum("n").over(window), F.lit(0))
    buckets = buckets.select("conv", "bucket", before(earlier(["conv"], ["bucket"])).alias("start"))
    cells = cells.withColumn("inside", before(earlier(["conv", "bucket"], ["turn", "slot"]))).join(buckets, ["conv", "bucket"])
    rank = F.row_number().over(Window.partitionBy("conv", "turn", "slot").orderBy(*order)) - 1
    placed = rows.withColumn("rank", rank).join(cells.select("conv", "turn", "slot", (F.col("start") + F.col("inside")).alias("first")), ["conv", "turn", "slot"])
    return placed.withColumn("at", F.col("first") + F.col("rank")).withColumn("part", F.floor(F.col("at") / rows_per_part).cast("long"))


def render_dialogues(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    context: tuple[str, ...] = ("system",),
    rows_per_part: int = 64,
) -> DataFrame:
    """Render each whole dialogue once for every participant, with that speaker as the assistant and the others as named users.

    A turn of the perspective's speaker is ``<|assistant|>\\ntext<|end|>\\n``; of another ``<|user name=NAME|>...``;
    speakers in ``context`` are no participants, and their turns are ``<|system|>...`` in every rendering. What reads as
    a mark in a text or name is ``escaped``. ``mask_spans`` has the character ranges ``start-end`` (end excluded) that
    training counts: text and end mark of the assistant's turns.

    A rendering comes in numbered parts of ``rows_per_part`` turns, so that no row holds an unbounded text. Put one
    after another they are the rendering, however it is cut; ``start`` and ``mask_spans`` count its characters, not the part's.

    Turns are in order of turn, then of the MD5 of speaker and text; repeated rows are repeated turns. A null text is
    empty; a null speaker is a participant named ``unknown``; a null turn counts as turn -1; rows of a null conversation
    are one dialogue. Texts of any length are one turn's, whole. A dialogue of context turns only has no participant and gives no row; an empty table gives an
    empty one. Other columns aren't read. Returns conv_id, perspective, part, start, n_turns, n_target_turns, text,
    mask_spans, target_chars.
    """
    rows = _said(turns, conv_col, turn_col, speaker_col, text_col)
    digest = F.md5(F.concat("speaker", F.lit("\n"), "said"))
    rows = _placed(rows.withColumn("digest", digest).withColumn("slot", F.substring("digest", 1, 2)), rows_per_part, ["digest", "speaker", "said"])
    is_context = F.col("speaker").isin(*context)
    head = F.when(is_context, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), escaped(F.col("speaker"), True), F.lit("|>\n")))
    body = F.concat(escaped(F.col("said")), F.lit("<|end|>"))
    placed = written(rows.select("conv", "part", "at", "speaker", head.alias("head"), body.alias("body")), "chat-turns")

    parts = placed.groupBy("conv", "part").agg(
        F.sort_array(F.collect_list(F.struct("at", "speaker", "head", "body"))).alias("turns"), F.sum(F.length("head") + F.length("body") + 1).alias("chars")
    )
    shorter = F.sum(F.lit(len(ASSISTANT)) - F.length("head")).alias("more")
    own = placed.where(~is_context).groupBy("conv", "part", F.col("speaker").alias("perspective")).agg(shorter)
    grid = parts.select("conv", "part", "chars").join(own.select("conv", "perspective").distinct(), "conv").join(own, ["conv", "part", "perspective"], "left")
    earlier = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("chars") + F.coalesce("more", F.lit(0))).over(earlier), F.lit(0))
    views = grid.select("conv", "part", "perspective", start.cast("long").alias("start")).join(parts.select("conv", "part", "turns"), ["conv", "part"])
    shown = F.transform(
        "turns",
        lambda t: F.struct(
            F.when(t["speaker"] == F.col("perspective"), F.lit(ASSISTANT)).otherwise(t["head"]).alias("head"),
            t["body"].alias("body"),
            (t["speaker"] == F.col("perspective")).alias("target"),
        ),
    )
    return _told(views.select(F.col("conv.id").alias("conv_id"), "perspective", "part", "start", F.size("turns").alias("n_turns"), shown.alias("shown")))


def _told(views: DataFrame) -> DataFrame:
    """The text and mask of each (conv_id, perspective, part, start, n_turns, shown), whose text begins at ``start``."""
    start = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("chars"))

    def add(a, s):
        begin = a["at"] + F.length(s["head"])
        stop = begin + F.length(s["body"])
        span = F.concat_ws("-", begin.cast("string"), stop.cast("string"))
        return F.struct(
            (stop + 1).alias("at"),
            F.when(s["target"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"),
            F.when(s["target"], a["chars"] + F.length(s["body"])).otherwise(a["chars"]).alias("chars"),
        )

    views = views.withColumn("mask", F.aggregate("shown", start, add))
    return views.select(
        "conv_id",
        "perspective",
        "part",
        "start",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.size(F.filter("shown", lambda s: s["target"])).cast("long").alias("n_target_turns"),
        F.array_join(F.transform("shown", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "").alias("text"),
        F.array_join("mask.spans", ",").alias("mask_spans"),
        F.col("mask.chars").cast("long").alias("target_chars"),
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_dialogues(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP9_SQL = r"""
WITH turns AS (
    SELECT conv_id, role AS speaker, text AS said,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(role || chr(10) || text), role, text) - 1 AS pos
    FROM (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)
), views AS (
    SELECT t.*, pos // 64 AS part, n.perspective, t.speaker = n.perspective AS target,
           CASE WHEN t.speaker = n.perspective THEN '<|assistant|>' || chr(10)
                WHEN t.speaker = 'system' THEN '<|system|>' || chr(10)
                ELSE '<|user name=' || regexp_replace(regexp_replace(t.speaker, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' || chr(10)
           END AS head,
           regexp_replace(t.said, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' AS body
    FROM turns t JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system') n
      ON t.conv_id IS NOT DISTINCT FROM n.conv_id
), placed AS (
    SELECT *, sum(length(head) + length(body) + 1) OVER (
        PARTITION BY conv_id, perspective ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
    FROM views
)
SELECT conv_id, perspective, part, CAST(min(stop - 1 - length(body) - length(head)) AS BIGINT) AS start,
       count(*) AS n_turns, count(*) FILTER (WHERE target) AS n_target_turns,
       string_agg(head || body || chr(10), '' ORDER BY pos) AS text,
       coalesce(string_agg(CAST(stop - 1 - length(body) AS BIGINT) || '-' || CAST(stop - 1 AS BIGINT), ',' ORDER BY pos)
                FILTER (WHERE target), '') AS mask_spans,
       CAST(coalesce(sum(length(body)) FILTER (WHERE target), 0) AS BIGINT) AS target_chars
FROM placed GROUP BY conv_id, perspective, part
"""
