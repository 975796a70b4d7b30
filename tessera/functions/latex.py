"""LaTeX tables of rows of text, and the YAML blocks in front of texts."""

from __future__ import annotations

#: What stands for the characters that LaTeX reads as commands.
ESCAPES = {
    "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}",
    "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}",
}
_TABLE = str.maketrans(ESCAPES)


def escape(text: str) -> str:
    """In one pass, so that the braces of a replacement are not escaped again."""
    return text.translate(_TABLE)


def tabular(header: list[str], rows: list[list[str]], sheet: str | None = None) -> str:
    """A table of the header's width; short rows are filled up, long ones cut. Without a header there is none."""
    if not header:
        return ""
    width = len(header)
    row_text = lambda cells: " & ".join(map(escape, (cells + [""] * width)[:width])) + r" \\"
    head = [f"% Sheet: {sheet}"] if sheet else []
    return "\n".join([*head, rf"\begin{{tabular}}{{{'l' * width}}}", r"\hline", row_text(header), r"\hline", *map(row_text, rows), r"\hline", r"\end{tabular}"])


def tables(header: list[str], rows: list[list[str]], sheet: str | None, most: int = 1800) -> list[str]:
    """Tables of as many rows as fit in ``most`` characters, each with the header; a row too long stands alone."""
    if not header:
        return []
    frame = len(tabular(header, [], sheet))
    found: list[str] = []
    group: list[list[str]] = []
    size = frame
    for row in rows:
        more = len(tabular(header, [row], sheet)) - frame
        if group and size + more > most:
            found.append(tabular(header, group, sheet))
            group, size = [], frame
        group.append(row)
        size += more
    return [*found, tabular(header, group, sheet)] if group or not found else found


def front_matter_block(text: str | None, name: str) -> dict[str, str] | None:
    """The ``key: value`` pairs indented under ``name:`` in the YAML between leading '---' lines; None without one.

    A comment ends a value at its '#'.
    """
    lines = (text or "").splitlines()
    if not lines or lines[0].strip() != "---":
        return None
    end = next((k for k, line in enumerate(lines[1:], 1) if line.strip() == "---"), 0)
    inside = lines[1:end] if end else []
    start = next((k for k, line in enumerate(inside) if line.strip() == f"{name}:"), None)
    if start is None:
        return None
    pairs: dict[str, str] = {}
    for line in inside[start + 1 :]:
        if not line.strip():
            continue
        if line[0] not in " \t":
            break
        key, colon, value = line.partition(":")
        if colon:
            pairs[key.strip()] = value.split("#", 1)[0].strip()
    return pairs
