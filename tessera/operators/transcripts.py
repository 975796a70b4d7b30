"""Session transcripts: messages, the newest within a budget, artifacts, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import strip

MAX_CHARS, MAX_TOOL_RESULT = 500_000, 500

#: What names commits, pull requests, branches and beads in a transcript, in order.
SHA_PATTERNS = [r"(?Ud)\bcommit\s+([0-9a-f]{7,12})\b", r"(?Ud)\[[^\]]+\s+([0-9a-f]{7,12})\]", r"(?Umd)^([0-9a-f]{7,12})\s"]
PR_PATTERNS = [
    r"(?Uiud)\bPR\s*#(\d{1,5})\b", r"(?Uiud)\bpull\s+(?:request\s+)?#(\d{1,5})\b", r"(?Uiud)\bmerged\s+#(\d{1,5})\b", r"(?Uiud)\b(?:pr|pulls?)/(\d{1,5})\b",
]
BRANCH_PATTERNS = [
    r"(?Ud)checkout\s+-b\s+([\w.-]+/[\w./-]+)", r"(?Ud)push\s+(?:-[^\s]+\s+)*\w+\s+([\w.-]+/[\w./-]+)",
    r"(?Ud)\bbranch\s+((?:feat|fix|chore|release|bugfix|hotfix|perf|refactor|docs|test)/[\w./-]+)",
    r"(?Ud)\((?:origin/)?((?:feat|fix|chore|release|bugfix|hotfix|perf|refactor|docs|test)/[\w./-]+)\)",
]
BEAD_PATTERNS = [
    r"(?Ud)\bbd\s+\w+\s+([a-z]+-[a-z0-9]{2,6})\b", r"(?Ud)\bbeads?\s+([a-z]+-[a-z0-9]{2,6})\b",
    r"(?Ud)\bCloses\s+([a-z]+-[a-z0-9]{2,6})\b", r"(?Ud)\bbeads?-([a-z]+-[a-z0-9]{2,6})\b",
]

BLOCK = "struct<type:string,text:string,content:string>"
MESSAGE = "type string, message struct<role:string,content:string>"


def _text_of(block: Column) -> Column:
    return F.when(block["type"] == "text", strip(F.coalesce(block["text"], F.lit("")))).otherwise(F.lit(""))


def message_text(line: Column) -> Column:
    """T13, S20, U8: '[role] text' of one JSONL record; null for what is no message of user or assistant.

    Content is a string, or blocks: texts are stripped and joined by spaces; a tool result of 1 to 500 characters comes
    with its mark; other blocks go. Lines that don't parse give null.
    """
    record = F.from_json(line, MESSAGE)
    content = record["message"]["content"]
    blocks = F.from_json(content, f"array<{BLOCK}>")

    def tool(block: Column) -> Column:
        inner = F.from_json(block["content"], f"array<{BLOCK}>")
        joined = F.array_join(F.filter(F.transform(inner, _text_of), lambda t: t != ""), " ")
        text = F.when(block["content"].startswith("["), F.coalesce(joined, strip(block["content"]))).otherwise(strip(block["content"]))
        size = F.length(F.coalesce(text, F.lit("")))
        return F.when((size > 0) & (size <= MAX_TOOL_RESULT), F.concat(F.lit("[tool_result] "), text)).otherwise(F.lit(""))

    texts = F.filter(F.transform(blocks, lambda b: F.when(b["type"] == "tool_result", tool(b)).otherwise(_text_of(b))), lambda t: t != "")
    is_list = content.startswith("[") & blocks.isNotNull()
    body = F.when(is_list, F.when(F.size(texts) > 0, F.array_join(texts, " "))).when(F.length(strip(content)) > 0, content)
    role = F.coalesce(record["message"]["role"], record["type"])
    return F.when(record["type"].isin("user", "assistant") & body.isNotNull(), F.concat(F.lit("["), role, F.lit("] "), body))


def within_budget(entries: DataFrame, session: str, order: str, text: str = "entry", budget: int = MAX_CHARS) -> DataFrame:
    """The newest entries of each session whose lengths sum to ``budget`` or less; a longest one alone may leave none."""
    rest = Window.partitionBy(session).orderBy(F.col(order)).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return entries.withColumn("_sum", F.sum(F.length(text)).over(rest)).where(F.col("_sum") <= budget).drop("_sum")


def session_texts(entries: DataFrame, session: str, order: str, text: str = "entry", budget: int = MAX_CHARS) -> DataFrame:
    """(session, text): kept entries in order, with blank lines between. A text is no longer than the budget."""
    kept = within_budget(entries.where(F.col(text).isNotNull()), session, order, text, budget)
    rows = kept.groupBy(session).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text)))).alias("rows"))
    return rows.select(session, F.array_join(F.col(f"rows.{text}"), "\n\n").alias("text"))


def counted_texts(entries: DataFrame, session: str, order: str, text: str = "entry", budget: int = MAX_CHARS) -> DataFrame:
    """(session, n_lines, text): how many rows each session has, null entries too, and ``session_texts``, null where that has no
    row; ``entries`` are read once for both.
    """
    rest = Window.partitionBy(session).orderBy(F.col(order)).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    summed = entries.withColumn("_sum", F.sum(F.length(text)).over(rest))
    kept = F.when(F.col(text).isNotNull() & (F.col("_sum") <= budget), F.struct(F.col(order), F.col(text)))
    rows = summed.groupBy(session).agg(F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list(kept)).alias("rows"))
    return rows.select(session, "n_lines", F.when(F.size("rows") > 0, F.array_join(F.col(f"rows.{text}"), "\n\n")).alias("text"))


def artifacts(text: Column) -> Column:
    """Commit SHAs, pull request numbers, branches and bead ids, each once in the order of patterns."""
    found = lambda patterns: F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))
    return F.struct(
        found(SHA_PATTERNS).alias("commit_shas"),
        F.array_distinct(F.transform(found(PR_PATTERNS), lambda n: n.cast("int"))).alias("pr_numbers"),
        found(BRANCH_PATTERNS).alias("branch_names"),
        found(BEAD_PATTERNS).alias("bead_ids"),
    )


def artifact_header(a: Column) -> Column:
    """The '## Session Artifacts' block, or ''."""
    numbers = F.transform(a["pr_numbers"], lambda n: F.concat(F.lit("#"), n.cast("string")))
    parts = [("Commits", a["commit_shas"]), ("PRs", numbers), ("Branches", a["branch_names"]), ("Beads", a["bead_ids"])]
    lines = F.concat_ws("\n", *[F.when(F.size(v) > 0, F.concat(F.lit(f"{n}: "), F.array_join(v, ", "))) for n, v in parts])
    return F.when(lines == "", lines).otherwise(F.concat(F.lit("## Session Artifacts\n"), lines))


def front_matter(a: Column, session_id: Column, timestamp: Column) -> Column:
    """The YAML block of a capture; '' without a session id."""
    parts = [("commits", a["commit_shas"]), ("prs", a["pr_numbers"].cast("array<string>")), ("branches", a["branch_names"]), ("beads", a["bead_ids"])]
    items = [F.when(F.size(v) > 0, F.concat(F.lit(f"{n}:\n  - "), F.array_join(v, "\n  - "))) for n, v in parts]
    block = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("session_id: "), session_id), F.concat(F.lit('timestamp: "'), timestamp, F.lit('"')), *items, F.lit("---"))
    return F.when(F.coalesce(session_id, F.lit("")) == "", F.lit("")).otherwise(block)


def document_of_session(session_id: Column) -> Column:
    return F.concat(F.lit("session-"), F.substring(session_id, 1, 8))


def encoded_directory(directory: Column) -> Column:
    """A directory as transcripts' folder names have it."""
    return F.replace(directory, F.lit("/"), F.lit("-"))


def backfill_plan(transcripts: DataFrame, directories: DataFrame, documents: DataFrame) -> DataFrame:
    """What becomes of each transcript (folder, session_id, text): ingested, skipped_unregistered,
    skipped_existing or skipped_empty. ``documents`` has (collection, document_name).
    """
    known = directories.select(encoded_directory(F.col("directory")).alias("folder"), F.concat("collection", F.lit("-captures")).alias("collection"))
    rows = transcripts.withColumn("document_name", document_of_session(F.col("session_id"))).join(known, "folder", "left")
    rows = rows.join(documents.select("collection", "document_name").distinct().withColumn("_there", F.lit(True)), ["collection", "document_name"], "left")
    outcome = (
        F.when(F.col("collection").isNull(), "skipped_unregistered")
        .when(F.col("_there"), "skipped_existing")
        .when(F.length(strip(F.coalesce("text", F.lit("")))) == 0, "skipped_empty")
        .otherwise("ingested")
    )
    return rows.withColumn("outcome", outcome).drop("_there")


def backfill_totals(planned: DataFrame, errors: bool = False) -> DataFrame:
    """A12; ``errors`` too of a backfill that was carried out."""
    names = ("ingested", "skipped_existing", "skipped_unregistered", "skipped_empty", *(("errors",) if errors else ()))
    return planned.agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def backfill_run(planned: DataFrame, limit: int = 0, errors: DataFrame | None = None) -> DataFrame:
    """The plan as it is carried out. With a ``limit`` the transcripts, by folder and session, are visited until so
    many were processed (ingested or found empty; those already there don't count); unregistered folders are told all the
    same. Those of ``errors`` (folder, session_id) become 'errors'. The cut is one row, which alone is broadcast.
    """
    visited = planned
    if limit > 0:
        place = F.struct("folder", "session_id")
        processed = planned.where(F.col("outcome").isin("ingested", "skipped_empty")).select(place.alias("at")).orderBy("at").limit(limit)
        cut = processed.agg(F.max("at").alias("_last"), (F.count(F.lit(1)) == limit).alias("_full"))
        visited = planned.join(F.broadcast(cut), F.lit(True), "inner")
        visited = visited.where((F.col("outcome") == "skipped_unregistered") | ~F.col("_full") | (place <= F.col("_last"))).drop("_last", "_full")
    if errors is None:
        return visited
    failed = errors.select("folder", "session_id").distinct().withColumn("_failed", F.lit(True))
    judged = F.when(F.col("_failed") & (F.col("outcome") == "ingested"), "errors").otherwise(F.col("outcome"))
    return visited.join(failed, ["folder", "session_id"], "left").withColumn("outcome", judged).drop("_failed")


def archives_to_delete(archives: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Of (session_prefix, path, modified), all but each prefix's newest, and those older than ``days``."""
    newest = Window.partitionBy("session_prefix").orderBy(F.desc("modified"), F.desc("path"))
    old = F.unix_timestamp(now) - F.unix_timestamp("modified") > days * 86400
    return archives.withColumn("_n", F.row_number().over(newest)).where((F.col("_n") > 1) | old).drop("_n")
