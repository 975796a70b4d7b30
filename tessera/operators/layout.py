"""Page layout to paragraphs: lines with boxes, as any layout reader gives them, joined over soft wraps.

Works on a table of lines: page (any key columns), block, line, text, x0, y0, x1, y1 and the page's height. Margins, gaps and
groups are windows over a page, which is the unit that can't grow without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import strip

#: Shares of the page height, points, and counts that the rules go by.
MARGIN_BAND, ISOLATION_GAP, SHORT_LINE = 0.12, 0.05, 0.15
MARGIN_TOLERANCE, ROW_TOLERANCE, CONTENTS_LINES = 2.0, 3.0, 2
YEARS = (1000, 2999)
DOT_LEADER = r"(?U)\.(?:\s*\.){3,}"
SENTENCE_CLOSE = "(?U)[.!?][\"'”’)\\]}]*\\s*$"
#: First parts of compounds, and compounds, that keep their hyphen over a line end.
HYPHEN_PREFIXES = ("self", "well", "co", "non", "anti", "pre", "re", "multi", "quasi")
HYPHEN_COMPOUNDS = ("state-of-the-art", "read-only", "long-term", "short-term")
#: The least characters of a page that counts as text.
TEXT_PAGE = 50


def page_class(text: Column) -> Column:
    """S14: 'text', or 'image' for a page to be recognized."""
    return F.when(F.length(strip(F.coalesce(text, F.lit("")))) >= TEXT_PAGE, F.lit("text")).otherwise(F.lit("image"))


def is_page_number(text: Column) -> Column:
    """One to four digits, but no year."""
    token = strip(text)
    year = (F.length(token) == 4) & token.cast("int").between(*YEARS)
    return token.rlike("^[0-9]{1,4}$") & ~F.coalesce(year, F.lit(False))


def ends_sentence(text: Column) -> Column:
    """T10: '.', '!' or '?' at the end, closing quotes and brackets aside."""
    return text.rlike(SENTENCE_CLOSE)


def is_dot_leader(text: Column) -> Column:
    """Four dots or more in a run, spaces between allowed."""
    return text.rlike(DOT_LEADER)


def merge_wrapped(done: Column, piece: Column) -> Column:
    """A line joined to the text so far. A hyphen between two letters goes, but for compounds; others stay."""
    left = F.regexp_extract(done, r"(?U)(\p{L}*)-$", 1)
    right = F.regexp_extract(piece, r"(?U)^(\p{L}*)", 1)
    keep = F.lower(left).isin(*HYPHEN_PREFIXES) | F.lower(F.concat(left, F.lit("-"), right)).isin(*HYPHEN_COMPOUNDS)
    return (
        F.when(F.length(done) == 0, piece)
        .when(~done.endswith("-"), F.concat(done, F.lit(" "), piece))
        .when((F.length(left) > 0) & (F.length(right) > 0) & ~keep, F.concat(F.regexp_replace(done, "-$", ""), piece))
        .otherwise(F.concat(done, piece))
    )


def _folded(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(""), merge_wrapped)


def without_page_numbers(lines: DataFrame, page: list[str]) -> DataFrame:
    """Lines of all blocks but lone page numbers in a margin band that stand apart from every other block.

    The nearest other block by vertical gap is one of the neighbours by running maximum of bottoms and by tops, so two
    windows over the blocks of a page do for the pairs of them.
    """
    extent = lines.groupBy(*page, "block").agg(
        F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.count(F.lit(1)).alias("n"), F.first("text").alias("only"), F.max("height").alias("height")
    )
    whole = Window.partitionBy(*page)
    up = whole.orderBy("top", "block").rowsBetween(Window.unboundedPreceding, -1)
    down = whole.orderBy("top", "block").rowsBetween(1, Window.unboundedFollowing)
    known = F.coalesce("height", F.lit(0.0)) > 0
    first, last = F.when(known, 0.0).otherwise(F.min("top").over(whole)), F.when(known, F.col("height")).otherwise(F.max("bottom").over(whole))
    rows = extent.select(
        *page, "block", "top", "bottom", "n", "only", first.alias("first"), last.alias("last"), F.max("bottom").over(up).alias("above"), F.min("top").over(down).alias("below")
    )
    far = F.lit(float("inf"))
    over = F.when(F.col("above").isNull(), far).otherwise(F.greatest(F.col("top") - F.col("above"), F.lit(0.0)))
    under = F.when(F.col("below").isNull(), far).otherwise(F.greatest(F.col("below") - F.col("bottom"), F.lit(0.0)))
    gap = F.least(over, under)
    span = F.col("last") - F.col("first")
    in_margin = (span <= 0) | (F.col("top") <= F.col("first") + MARGIN_BAND * span) | (F.col("bottom") >= F.col("last") - MARGIN_BAND * span)
    chrome = (F.col("n") == 1) & is_page_number(F.col("only")) & in_margin & (gap >= ISOLATION_GAP * span)
    return lines.join(rows.where(chrome).select(*page, "block"), [*page, "block"], "left_anti")


def paragraphs_of_lines(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, block, paragraph, text). Blank lines go first.

    A block with two or more dot leaders is a table of contents: its rows are runs of lines whose tops differ by little,
    joined from left to right. In prose a line joins the one before, unless that ends a sentence before a capital and
    reaches the right margin or falls well short of it.
    """
    rows = without_page_numbers(lines.where(F.length(strip(F.col("text"))) > 0), page)
    block = Window.partitionBy(*page, "block")
    rows = rows.withColumns(
        {"right": F.max("x1").over(block), "left": F.min("x0").over(block), "contents": F.sum(is_dot_leader(F.col("text")).cast("int")).over(block) >= CONTENTS_LINES}
    )
    reading = Window.partitionBy(*page, "block").orderBy("line")
    gap = F.col("right") - F.lag("x1").over(reading)
    new_sentence = ends_sentence(F.lag("text").over(reading)) & strip(F.col("text")).rlike(r"^\p{Lu}")
    breaks = new_sentence & ((gap <= MARGIN_TOLERANCE) | (gap > SHORT_LINE * (F.col("right") - F.col("left"))))
    by_top = Window.partitionBy(*page, "block").orderBy("y0", "x0", "line")
    new_row = F.col("y0") - F.lag("y0").over(by_top) > ROW_TOLERANCE
    rows = rows.withColumns({"_break": F.coalesce(breaks, F.lit(False)).cast("int"), "_row": F.coalesce(new_row, F.lit(False)).cast("int")})
    rows = rows.withColumn("paragraph", F.when(F.col("contents"), F.sum("_row").over(by_top)).otherwise(F.sum("_break").over(reading)))
    place = F.when(F.col("contents"), F.struct(F.col("x0").alias("at"), F.col("line"))).otherwise(F.struct(F.lit(0.0).cast("double").alias("at"), F.col("line")))
    piece = F.struct(place.alias("place"), strip(F.col("text")).alias("text"))
    grouped = rows.groupBy(*page, "block", "paragraph", "contents").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    joined = F.when(F.col("contents"), F.array_join("pieces.text", " ")).otherwise(_folded(F.col("pieces.text")))
    return grouped.select(*page, "block", "paragraph", joined.alias("text"))


def page_texts(lines: DataFrame, page: list[str]) -> DataFrame:
    """One text for each page, blank lines between paragraphs."""
    rows = paragraphs_of_lines(lines, page)
    found = rows.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("block", "paragraph", "text"))).alias("rows"))
    return found.select(*page, F.array_join("rows.text", "\n\n").alias("text"))
