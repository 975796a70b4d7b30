"""Definitions of languages with braces, told apart in the JVM by one pass over a text's tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of languages whose blocks are braces; in the second group a single quote begins one character, not a string.
SCRIPTS = (".js", ".jsx", ".ts", ".tsx", ".php", ".dart", ".kt", ".kts", ".swift", ".scala", ".go", ".vue", ".svelte")
CHARACTERS = (".java", ".c", ".h", ".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".cs", ".rs", ".zig")
BRACED = SCRIPTS + CHARACTERS

_COMMENT = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\z)"
_STRING = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"?|`[^`]*+`?'
_QUOTED = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'?"
_CHARACTER = r"'(?:\\[^'\n]{1,10}|[^'\\\n])'|'"
_REST = r"[{}()\[\];\n]|[^{}()\[\];\n\"'`/]+|/"

#: What the head of a definition looks like: a word that names one, or a name with parameters before the block.
_WORDS = "class|interface|enum|struct|union|record|trait|impl|mod|module|namespace|object|protocol|extension|func|function|fun|fn|def|type|template"
_MODIFIERS = (
    r"(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|declare|pub(?:\([^)]*\))?|unsafe|const|extern|inline|virtual|sealed|open|data|case|implicit"
    r"|override|suspend|partial|readonly|strictfp|typedef|@\w+(?:\([^)]*\))?|#\[[^\]]*\])\s+)*"
)
_NAMED = rf"(?s)^\s*{_MODIFIERS}(?:{_WORDS})\b"
_WITH_PARAMETERS = r"(?s)^[^={}();]*\b\w+\s*\([^{};]*\)[^={};()]*\{"


def tokens(text: Column, characters: Column) -> Column:
    """Comments, strings, brackets, ends of lines and what is between, which put together are the text."""
    of = lambda quote: F.regexp_extract_all(text, F.lit(f"{_COMMENT}|{_STRING}|{quote}|{_REST}"), F.lit(0))
    return F.when(characters, of(_CHARACTER)).otherwise(of(_QUOTED))


def brace_sections(text: Column, characters: Column) -> Column:
    """Top-level pieces of ``text``: every definition is a section, runs of other pieces (and comments) are one, stripped.

    A fold over the tokens counts brackets outside of comments and strings, which are tokens themselves; a piece ends outside of all
    brackets after a semicolon, after a block that the line ends behind, or at the end of a line that isn't followed by an opening brace
    and isn't an annotation.
    ``characters`` says whether a single quote begins a character. Unbalanced brackets end no piece: the rest is one.
    """
    every = tokens(text, characters)
    indexed = F.arrays_zip(every.alias("t"), F.sequence(F.lit(0), F.size(every)).alias("at"))
    indexed = F.slice(indexed, F.lit(1), F.size(every))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("begin"), F.lit(False).alias("some"), F.lit(False).alias("ended"), F.lit(0).alias("line"),
        F.array().cast("array<struct<a:int,b:int>>").alias("cuts"),
    )

    def put(s: Column, x: Column) -> Column:
        t, at = x["t"], x["at"].cast("int")
        opens, closes = t.isin("{", "(", "["), t.isin("}", ")", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes & (s["depth"] > 0), -1).otherwise(0)
        blank = F.trim(t) == ""
        # A piece that has ended takes along what stands on its line; the next token that opens a block of it goes on with it.
        fresh = s["ended"] & ~((t == "\n") | blank | (t.startswith("//") & (s["line"] != 0)) | (t == ";") | (t == "{"))
        done = s["some"] & fresh
        cuts = F.when(done, F.concat(s["cuts"], F.array(F.struct(s["begin"].alias("a"), at.alias("b"))))).otherwise(s["cuts"])
        begin = F.when(done, at).otherwise(s["begin"])
        some = F.when(done, F.lit(True)).otherwise(s["some"] | ~(blank | (t == "\n")))
        # A line is new (0), of an annotation or the like, which belongs to what follows (2), or any other (1).
        noted = F.trim(t).startswith("@") | (F.trim(t) == "#") | F.trim(t).startswith("template")
        line = F.when(t == "\n", 0).when((s["line"] == 0) & ~blank, F.when(noted, 2).otherwise(1)).otherwise(s["line"])
        ends = (depth == 0) & ((t == ";") | ((t == "\n") & (s["line"] != 2)) | (t == "}"))
        ended = F.when(~some, F.lit(False)).when(ends, F.lit(True)).when(s["ended"] & ~fresh & (t != "{"), F.lit(True)).otherwise(F.lit(False))
        return F.struct(depth.alias("depth"), begin.alias("begin"), some.alias("some"), ended.alias("ended"), line.alias("line"), cuts.alias("cuts"))

    state = F.aggregate(indexed, start, put)
    ranges = F.concat(state["cuts"], F.array(F.struct(state["begin"].alias("a"), F.size(every).alias("b"))))
    pieces = F.transform(ranges, lambda r: F.array_join(F.slice(every, r["a"] + 1, F.greatest(r["b"] - r["a"], F.lit(0))), ""))
    pieces = F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+|\s+\z", "")), lambda p: p != "")

    def gather(done: Column, piece: Column) -> Column:
        bare = F.regexp_replace(piece, rf"^(?:\s*(?:{_COMMENT}))+\s*", "")
        defines = bare.rlike(_NAMED) | bare.rlike(_WITH_PARAMETERS)
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & ~defines & ~F.coalesce(F.try_element_at(done, F.lit(-1))["defines"], F.lit(True))
        one = F.struct(piece.alias("text"), defines.alias("defines"))
        joined = F.struct(F.concat(last["text"], F.lit("\n"), piece).alias("text"), F.lit(False).alias("defines"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(one)))

    sections = F.aggregate(pieces, F.array().cast("array<struct<text:string,defines:boolean>>"), gather)
    return F.transform(sections, lambda s: s["text"])
