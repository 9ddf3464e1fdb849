"""Facts of Markdown and of notebooks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from graphloom.sources.facts import Fact, module_of
from graphloom.sources.python_code import extract as python

_HEADING = re.compile(r"^#{1,6}(?:\s+(.*?))?\s*#*\s*$")


def sections(text: str) -> list[tuple[str | None, str, int, int]]:
    """Title, body, first and last line of each section; a body ahead of all headings counts if it isn't blank."""
    out: list[tuple[str | None, str, int, int]] = []
    title, body, first = None, [], 1
    lines = text.split("\n")

    def end(last: int) -> None:
        if title is not None or "".join(body).strip():
            out.append((title, "\n".join(body).strip(), first, max(last, first)))

    for k, line in enumerate(lines, 1):
        if m := _HEADING.match(line):
            end(k - 1)
            title, body, first = m[1] or "", [], k
        else:
            body.append(line)
    end(len(lines))
    return out


def markdown(path: str, text: str) -> Iterator[Fact]:
    for title, body, first, last in sections(text):
        yield Fact("doc", title or "", module_of(path), "Markdown", body, first, last)


def notebook(path: str, text: str) -> Iterator[Fact]:
    """Code cells as one Python source, with lines that only the notebook understands left blank; text cells as docs."""
    cells = json.loads(text).get("cells", [])
    source = lambda c: "".join(s) if isinstance(s := c.get("source", ""), list) else s
    code = "\n".join(source(c) for c in cells if c.get("cell_type") == "code")
    yield from python(path, re.sub(r"(?m)^\s*[%!].*$", "", code))
    for c in cells:
        if c.get("cell_type") == "markdown":
            yield from markdown(path, source(c))
