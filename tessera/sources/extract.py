"""Files of several formats as pages: one row (path, content) gives rows of numbered sections.

Files come from Spark's ``binaryFile`` source, so any store will do; a file is handled whole in one task, files side by side.
"""

from __future__ import annotations

import ast
import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.code import BRACED, CHARACTERS, brace_sections
from tessera.functions import text as tx
from tessera.functions.html import html_sections, with_markdown
from tessera.functions.latex import escape, tables, tabular
from tessera.operators.chunking import pages_of_sections

WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DRAW_NS = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE_NS = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BLANK = re.compile(r"\n\s*\n")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, size, content) of all files under ``root``; filter on path before content is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def decoded(content: bytes) -> str:
    """UTF-8, else Windows-1252, else Latin-1, which takes any bytes."""
    for charset in ("utf-8", "cp1252"):
        try:
            return content.decode(charset)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def docx_sections(content: bytes) -> list[str]:
    """Paragraphs of a Word file; a heading opens a section if one is open. Blank paragraphs go."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    sections: list[list[str]] = [[]]
    for paragraph in root.iter(f"{WORD_NS}p"):
        words = "".join(t.text or "" for t in paragraph.iter(f"{WORD_NS}t"))
        if not words.strip():
            continue
        style = paragraph.find(f"{WORD_NS}pPr/{WORD_NS}pStyle")
        if style is not None and style.get(f"{WORD_NS}val", "").startswith("Heading") and sections[-1]:
            sections.append([])
        sections[-1].append(words)
    return ["\n".join(s) for s in sections if s]


def csv_sections(content: bytes) -> list[str]:
    """S11 for CSV: the first row is the header."""
    rows = list(csv.reader(io.StringIO(decoded(content), newline="")))
    return tables(rows[0], rows[1:], None) if rows else []


def _cells(sheet: ET.Element, shared: list[str]) -> list[list[str]]:
    rows = []
    for row in sheet.iter(f"{SHEET_NS}row"):
        cells: dict[int, str] = {}
        for at, cell in enumerate(row.iter(f"{SHEET_NS}c")):
            letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
            place = at
            if letters:
                place = 0
                for ch in letters:
                    place = place * 26 + ord(ch) - 64
                place -= 1
            value = cell.find(f"{SHEET_NS}v")
            if cell.get("t") == "inlineStr":
                cells[place] = "".join(t.text or "" for t in cell.iter(f"{SHEET_NS}t"))
            elif value is not None and value.text is not None:
                cells[place] = shared[int(value.text)] if cell.get("t") == "s" else value.text
        rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return rows


def xlsx_sections(content: bytes) -> list[str]:
    """S11 for workbooks: stored values of each sheet; sheets are named if there are several."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = set(archive.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in item.iter(f"{SHEET_NS}t")) for item in ET.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{SHEET_NS}si")]
    targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    sheets = []
    for sheet in ET.fromstring(archive.read("xl/workbook.xml")).iter(f"{SHEET_NS}sheet"):
        target = targets.get(sheet.get(f"{REL_NS}id"), "")
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if path in names and (rows := _cells(ET.fromstring(archive.read(path)), shared)):
            sheets.append((sheet.get("name"), rows))
    found: list[str] = []
    for name, rows in sheets:
        found += tables(rows[0], rows[1:], name if len(sheets) > 1 else None)
    return found


def _lines(shape: ET.Element) -> str:
    paragraphs = ["".join(t.text or "" for t in p.iter(f"{DRAW_NS}t")) for p in shape.iter(f"{DRAW_NS}p")]
    return "\n".join(paragraphs).strip()


def pptx_sections(content: bytes) -> list[str]:
    """A page for each slide that has something: title, shapes and tables in order, then the speaker's notes."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = set(archive.namelist())
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    found = []
    for name in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
        title, body = "", []
        for shape in ET.fromstring(archive.read(name)).iter():
            if shape.tag == f"{SLIDE_NS}graphicFrame":
                rows = [[_lines(c) for c in row.iter(f"{DRAW_NS}tc")] for row in shape.iter(f"{DRAW_NS}tr")]
                body += [tabular(rows[0], rows[1:])] if rows else []
            elif shape.tag == f"{SLIDE_NS}sp" and (words := _lines(shape)):
                kind = shape.find(f".//{SLIDE_NS}ph")
                if not title and kind is not None and kind.get("type") in ("title", "ctrTitle"):
                    title = words
                else:
                    body.append(escape(words))
        notes = ""
        rels = f"ppt/slides/_rels/{name.rsplit('/', 1)[1]}.rels"
        if rels in names:
            for link in ET.fromstring(archive.read(rels)):
                path = "ppt/" + link.get("Target", "").removeprefix("../")
                if link.get("Type", "").endswith("/notesSlide") and path in names:
                    for shape in ET.fromstring(archive.read(path)).iter(f"{SLIDE_NS}sp"):
                        kind = shape.find(f".//{SLIDE_NS}ph")
                        if kind is not None and kind.get("type") == "body":
                            notes = _lines(shape)
        parts = [f"# {escape(title)}" if title else "", *body, f"---\nSpeaker Notes:\n{escape(notes)}" if notes else ""]
        if any(parts):
            found.append("\n\n".join(filter(None, parts)))
    return found


def python_sections(source: str) -> list[str] | None:
    """Every top-level definition, with decorators, is a section, runs of other statements (and comments) are one; None if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    lines = source.splitlines()
    found: list[str] = []
    rest: list[str] = []
    at = 0

    def flush(upto: int) -> None:
        rest.extend(line.rstrip() for line in lines[at:upto] if line.strip())

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1
            flush(start)
            if rest:
                found.append("\n".join(rest))
                rest = []
            found.append("\n".join(lines[start : node.end_lineno]).strip())
            at = node.end_lineno
    flush(len(lines))
    return [*found, *(["\n".join(rest)] if rest else [])]


def code_sections(path: str, content: bytes) -> list[str]:
    """By definitions where the language's parser is at hand (Python), else by blank lines."""
    source = decoded(content)
    if not source.strip():
        return []
    found = python_sections(source) if path.lower().endswith(".py") else None
    return found if found else [p for p in BLANK.split(source) if p.strip()]


#: What turns a file into sections, by handler.
Extractor = Callable[[str, bytes], list[str]]
BINARY: dict[str, tuple[Extractor, str]] = {
    ".docx": (lambda path, content: docx_sections(content), "section"),
    ".csv": (lambda path, content: csv_sections(content), "spreadsheet"),
    ".xlsx": (lambda path, content: xlsx_sections(content), "spreadsheet"),
    ".pptx": (lambda path, content: pptx_sections(content), "presentation"),
}


def no_recognition(content: bytes) -> list[str]:
    """The default recognizer finds no page."""
    return []


def extract_pages(found: DataFrame, recognize: Callable[[bytes], list[str]] = no_recognition, more: dict[str, tuple[Extractor, str]] | None = None) -> DataFrame:
    """Pages of files (path, content); the suffix says how a file is read, unknown ones are left out.

    Plain, Markdown, LaTeX and HTML texts, and code of languages with braces, are only decoded in Python and split in the JVM. ``recognize`` gives the texts
    of an image's pages; ``more`` adds or replaces handlers by suffix. A file that can't be parsed has no pages and its
    reason in ``error``. Columns: document_name, document_path, page_number, total_pages, text, page_type, source_format, error.
    """
    handlers = BINARY | (more or {})
    suffix = tx.format_of(F.col("path"))
    rows = found.select("path", "content", suffix.alias("source_format"), tx.handler_of(F.col("path")).alias("handler"))
    rows = rows.where(F.col("handler").isNotNull() | suffix.isin(*handlers))

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content, kind, handler in zip(frame["path"], frame["content"], frame["source_format"], frame["handler"]):
                sections, page_type, whole, error = [], "section", None, None
                try:
                    content = bytes(content or b"")
                    if kind in handlers:
                        make, page_type = handlers[kind]
                        sections = make(path, content)
                    elif handler == "code" and kind in BRACED:
                        whole, page_type = decoded(content), "code"
                    elif handler == "code":
                        sections, page_type = code_sections(path, content), "code"
                    elif handler == "image":
                        sections, page_type = recognize(content), "image"
                    elif handler in ("text", "html"):
                        whole = decoded(content)
                except Exception as problem:  # one bad file doesn't end the job
                    error = f"{type(problem).__name__}: {problem}"
                out.append((path, kind, handler, page_type, whole, sections, error))
            yield pd.DataFrame(out, columns=["path", "source_format", "handler", "page_type", "whole", "parts", "error"])

    made = rows.mapInPandas(parsed, "path string, source_format string, handler string, page_type string, whole string, parts array<string>, error string")
    kind = F.when(F.col("source_format") == ".md", "markdown").when(F.col("source_format") == ".tex", "latex").otherwise("auto")
    is_html, is_text = F.col("handler") == "html", F.col("whole").isNotNull()
    html = pages_of_sections(_named(with_markdown(made.where(is_html & is_text), "whole", "whole")), html_sections(F.col("whole")))
    braced = F.col("handler") == "code"
    texts = pages_of_sections(_named(made.where(~is_html & ~braced & is_text)), tx.sections(F.col("whole"), kind))
    code = pages_of_sections(_named(made.where(braced & is_text)), brace_sections(F.col("whole"), F.col("source_format").isin(*CHARACTERS)), "code")
    other = made.where(~is_text)
    parts = pages_of_sections(_named(other), F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array(F.lit(""))))
    parts = parts.withColumns({"page_type": F.col("kept_type"), "total_pages": F.size("parts")}).where((F.col("text") != "") | F.col("error").isNotNull())
    columns = ["document_name", "document_path", "page_number", "total_pages", "text", "page_type", "source_format", "error"]
    return html.select(columns).unionByName(texts.select(columns)).unionByName(code.select(columns)).unionByName(parts.select(columns))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("page_type", "kept_type").withColumns({"document_name": F.regexp_extract("path", r"([^/]+)$", 1), "document_path": F.col("path")})
