"""Text expressions: strip, section splits, sentence-packed chunks, excerpts. All run in the JVM, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heading, LaTeX section, blank line, HTML comment and sentence boundaries.
MARKDOWN_HEADING = r"(?Umd)^(?=#+\s)"
LATEX_SECTION = r"(?=\\(?:sub)?section\{)"
BLANK_LINE = r"(?U)\n\s*\n"
HTML_COMMENT = r"(?s)<!--.*?-->"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
#: The characters of Unicode's property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

MAX_CHARS, OVERLAP_CHARS = 1800, 200


def strip(text: Column) -> Column:
    """White space of any kind off both ends (Spark's ``trim`` takes off spaces alone); only the ends are looked at."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def _with_content(parts: Column, ignore_comments: bool) -> Column:
    bare = (lambda p: F.regexp_replace(p, HTML_COMMENT, "")) if ignore_comments else (lambda p: p)
    return F.filter(parts, lambda p: F.length(strip(bare(p))) > 0)


def markdown_sections(text: Column) -> Column:
    """Sections that begin at headings; parts of only white space or comments go."""
    return _with_content(F.split(text, MARKDOWN_HEADING), True)


def latex_sections(text: Column) -> Column:
    """Sections that begin at ``\\section{`` or ``\\subsection{``."""
    return _with_content(F.split(text, LATEX_SECTION), False)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, not stripped."""
    return _with_content(F.split(text, BLANK_LINE), False)


def detect_format(text: Column) -> Column:
    """T4: 'markdown', else 'latex', else 'plain'."""
    return (
        F.when(text.rlike(r"(?Umd)^#+\s"), F.lit("markdown")).when(text.rlike(r"\\(?:sub)?section\{"), F.lit("latex")).otherwise(F.lit("plain"))
    )


def sections(text: Column, kind: Column) -> Column:
    """Sections of ``text`` by its format name; 'auto' detects."""
    kind = F.when(kind == "auto", detect_format(text)).otherwise(kind)
    return F.when(kind == "markdown", markdown_sections(text)).when(kind == "latex", latex_sections(text)).otherwise(paragraphs(text))


def chunk(text: Column, max_chars: int = MAX_CHARS, overlap_chars: int = OVERLAP_CHARS) -> Column:
    """Sentence-packed chunks of a text, as an array.

    One fold over the sentences. A sentence that would make the running length exceed ``max_chars`` closes the chunk;
    the next one opens with the end of the closed chunk (its last ``overlap_chars``, from after their first space), but
    only if the closed chunk is longer than that. Sentences add their length + 1, an overlap only its length; a long
    sentence is never split. Blank text gives no chunk.
    """
    whole = strip(text)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))

    def tail(closed: Column) -> Column:
        end = F.substring(closed, -overlap_chars, overlap_chars)
        space = F.instr(end, " ")
        return F.when(space > 0, F.substr(end, space + 1)).otherwise(end)

    def add(a: Column, sentence: Column) -> Column:
        full = (a["size"] + F.length(sentence) > max_chars) & a["open"].isNotNull()
        over = F.length(a["open"]) > overlap_chars
        rest = F.when(over, tail(a["open"]))
        kept = F.when(full, rest).otherwise(a["open"])
        size = F.when(full, F.coalesce(F.length(rest), F.lit(0))).otherwise(a["size"])
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.concat_ws(" ", kept, sentence).alias("open"),
            (size + F.length(sentence) + 1).alias("size"),
        )

    packed = F.aggregate(F.split(whole, SENTENCE_END), start, add, lambda a: F.concat(a["done"], F.array(a["open"])))
    none = F.array().cast("array<string>")
    return F.when(F.length(whole) == 0, none).when(F.length(whole) <= max_chars, F.array(whole)).otherwise(packed)


def excerpt(text: Column, most: int = 160) -> Column:
    """White space collapsed, cut to ``most`` characters with dots."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("...")))


def docid(document_name: Column, page_number: Column | None = None) -> Column:
    """The name without white space, with '#p<n>' for a positive page, else '#doc'."""
    slug = F.regexp_replace(strip(document_name), r"(?U)\s+", "_")
    if page_number is None:
        return F.concat(slug, F.lit("#doc"))
    return F.concat(slug, F.when(page_number > 0, F.concat(F.lit("#p"), page_number.cast("string"))).otherwise(F.lit("#doc")))


#: What ends a line for a line-by-line reading.
LINE_END = r"(?<=[\n\x0B\f\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"


def lines(text: Column) -> Column:
    """Lines with their ends kept."""
    return F.filter(F.split(text, LINE_END), lambda s: F.length(s) > 0)


def is_structural(text: Column, least_words: int = 12) -> Column:
    """whether a chunk reads as metadata: changelog, title of one, table of contents, front matter, heading stub."""
    content = F.filter(F.transform(lines(text), lambda s: F.regexp_replace(s, r"[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]+$", "")), lambda s: F.length(strip(s)) > 0)
    n = F.size(content)
    matching = lambda pattern: F.size(F.filter(content, lambda s: s.rlike(pattern)))
    changelog = text.rlike(r"(?Umd)^#{1,4}\s*\[?\d+\.\d+") | text.rlike(r"(?Uimd)^#{2,4}\s+(Added|Changed|Fixed|Removed|Deprecated|Security)\b")
    title = F.lower(F.substring(text, 1, 120)).rlike("changelog|table of contents|revision history")
    toc = (n >= 3) & (matching(r"(?U)^\s*[-*]\s*\[.+\]\(.+\)\s*$") >= F.greatest(F.lit(3), F.floor(n / 2)))
    front = text.rlike(r"(?U)^\s*---") | ((n >= 2) & (matching(r"(?U)^[A-Za-z][\w .-]*:\s+\S") >= F.greatest(F.lit(2), F.floor(n * 2 / 3))))
    stub = (n == 0) | ((matching(r"(?U)^\s*#{1,6}\s+\S") > 0) & (F.regexp_count(text, F.lit("[A-Za-z]{2,}")) < least_words))
    return changelog | title | toc | front | stub


def format_of(path: Column) -> Column:
    """The lower-case suffix with its dot, or '' (U12)."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


#: Suffixes of each handler; what is in none of them is refused.
HANDLERS = {
    "pdf": [".pdf"],
    "text": [".txt", ".md", ".tex", ".docx"],
    "html": [".html", ".htm"],
    "spreadsheet": [".xlsx", ".csv"],
    "presentation": [".pptx"],
    "image": [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"],
    "code": [
        ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".h", ".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".cs", ".go", ".rs", ".rb",
        ".php", ".swift", ".kt", ".kts", ".scala", ".sh", ".bash", ".zsh", ".r", ".lua", ".pl", ".pm", ".ex", ".exs", ".erl", ".hs",
        ".ml", ".sql", ".zig", ".dart", ".nim", ".vue", ".svelte",
    ],
}


def handler_of(path: Column, strict: bool = False) -> Column:
    """The handler of a file by its suffix; null (or an error, if ``strict``) for others."""
    suffix = format_of(path)
    found = F.lit(None).cast("string")
    for name, suffixes in HANDLERS.items():
        found = F.when(suffix.isin(suffixes), F.lit(name)).otherwise(found)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unsupported file type: "), suffix)).cast("string")).otherwise(found) if strict else found
