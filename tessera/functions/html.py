"""Web pages to Markdown, as a column; splitting it into sections stays in the JVM."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import markdown_sections, paragraphs
from tessera.operators.chunking import pages_of_sections

#: Elements whose content is no article text.
BOILERPLATE = frozenset({"script", "style", "nav", "header", "footer", "aside", "form", "noscript"})
BLOCKS = frozenset("p div article section main blockquote table tr ul ol dl figure address details".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADING = re.compile(r"h([1-6])$")


class _Markdown(HTMLParser):
    """Collects Markdown: ATX headings, '-' bullets, emphasis, links and code; an unclosed boilerplate element ends with its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title = ""
        self.parts: dict[bool, list[str]] = {False: [], True: []}  # by whether they lie in the body
        self.open: list[str] = []
        self.in_body = False
        self.links: list[str] = []

    @property
    def _hidden(self) -> bool:
        return any(tag in BOILERPLATE for tag in self.open)

    def _put(self, text: str) -> None:
        if not self._hidden and "title" not in self.open:
            self.parts[self.in_body].append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self.in_body = True
        if tag == "br":
            self._put("  \n")
        elif tag == "hr":
            self._put("\n\n---\n\n")
        elif found := HEADING.match(tag):
            self._put("\n\n" + "#" * int(found[1]) + " ")
        elif tag == "li":
            self._put("\n- ")
        elif tag in BLOCKS:
            self._put("\n\n")
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag in ("code", "pre"):
            self._put("\n\n```\n" if tag == "pre" else "`" * ("pre" not in self.open))
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self._put("[" if self.links[-1] else "")
        elif tag in ("td", "th"):
            self._put(" | ")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            if last == "a" and self.links:
                href = self.links.pop()
                self._put(f"]({href})" if href else "")
            if last == tag:
                break
        if HEADING.match(tag) or tag in BLOCKS:
            self._put("\n\n")
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag == "pre":
            self._put("\n```\n\n")
        elif tag == "code" and "pre" not in self.open:
            self._put("`")

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "title":
            self.title += data
        elif "pre" in self.open:
            self._put(data)
        else:
            self._put(re.sub(r"\s+", " ", data))


def is_headed(markdown: str) -> bool:
    """Whether a line, without its indent, begins with '#' and a space or '#'."""
    return any(line.lstrip()[:2] in ("# ", "##") for line in markdown.splitlines())


def page_markdown(html: str | None) -> str:
    """T5: the article of a page as Markdown. The title comes in front only if there is no heading."""
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    text = "".join(parser.parts[True] if parser.in_body else parser.parts[False])
    lines = [re.sub(r"[ \t]+$", "", line) if not line.endswith("  ") else line.rstrip() + "  " for line in text.split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(line.lstrip(" ") for line in lines)).strip("\n")
    title = parser.title.strip()
    return f"# {title}\n\n{text}" if title and not is_headed(text) else text


#: Characters of Markdown that a worker holds before it passes them on.
MOST_HELD = 1 << 22


def with_markdown(pages: DataFrame, html: str, out: str = "_markdown") -> DataFrame:
    """``pages`` with the Markdown of the column ``html`` in place of it; a null page is ''. Pages are converted one by
    one, once each, as no filter is pushed below; a worker holds a batch of them as it came, and ``MOST_HELD`` characters of what is made.
    """
    others = [c for c in pages.columns if c != html]
    types = {f.name: f.dataType.simpleString() for f in pages.schema}

    def converted(batches):
        for batch in batches:
            own, kept, held, begin = batch.column(html), [], 0, 0
            for at in range(len(batch)):
                kept.append(page_markdown(own[at].as_py()))
                held += len(kept[-1])
                if held > MOST_HELD or at == len(batch) - 1:
                    arrays = [*(batch.column(c).slice(begin, len(kept)) for c in others), pa.array(kept, pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*others, out])
                    kept, held, begin = [], 0, at + 1

    return pages.mapInArrow(converted, ", ".join([*(f"`{c}` {types[c]}" for c in others), f"{out} string"]))


def html_sections(markdown: Column) -> Column:
    """Sections of a converted page, at headings if there are any, else paragraphs."""
    return F.when(markdown.rlike(r"(?m)^\s*#[ #]"), markdown_sections(markdown)).otherwise(paragraphs(markdown))


def html_pages(pages: DataFrame, name_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, html) rows as numbered section pages."""
    given = pages.select(F.col(name_col).alias("document_name"), F.col(html_col).alias("_html"))
    named = with_markdown(given, "_html").select("document_name", F.col("document_name").alias("document_path"), "_markdown")
    return pages_of_sections(named, html_sections(F.col("_markdown"))).drop("_markdown")
