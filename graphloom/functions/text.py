"""Scalar functions on texts, paths and names, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by lower-case extension. Fixed values.
LANGUAGES = {
    "py": "python", "rs": "rust", "fs": "fsharp", "fsx": "fsharp", "fsi": "fsharp", "mojo": "mojo", "🔥": "mojo", "kt": "kotlin", "kts": "kotlin",
    "swift": "swift", "md": "markdown", "ipynb": "jupyter", "xml": "xml", "toml": "toml", "json": "json", "yaml": "yaml", "yml": "yaml",
}


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), ext)


def line_count(text: Column) -> Column:
    """Line feeds, and one more if the text doesn't end with one; an empty text has none."""
    n = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(n + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def escape_like(text: str) -> str:
    """A text as a pattern for ``LIKE`` that matches it alone."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def source_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines from ``first`` to ``last``, counted from 1."""
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def links(html: Column) -> Column:
    """Targets of ``href`` attributes in double quotes, in page order."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)
