"""Extraction: source text to fact rows, one adapter a language, run over files in parallel.

An adapter is a plain function ``(path, text) -> iterable of Fact`` and knows nothing of Spark. ``extract`` applies the one of
each file's language; a file that an adapter can't read gives a ``diagnostic`` fact and never fails the run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.matching import similarity_target
from graphloom.shipping import ship

#: Facts that go back to Spark at once, at least; a task holds no more than these and one file's.
AT_ONCE = 20_000
SCHEMA = "path string, fact string, name string, qualified_name string, kind string, target string, start_line long, end_line long, ordering long, detail map<string,string>"


@dataclass
class Fact:
    """``fact``: symbol, import, call, type, base, decorator, test, doc, route, model, field, validator, spawn, channel, end, send, unsafe, ffi, package, dependency, resource, link or diagnostic."""

    fact: str
    name: str
    qualified_name: str = ""
    kind: str = ""
    target: str | None = None
    start_line: int = 0
    end_line: int = 0
    ordering: int | None = None
    detail: dict[str, str] = field(default_factory=dict)


Adapter = Callable[[str, str], Iterable[Fact]]


def module_of(path: str, separator: str = "::") -> str:
    """``src/a/b.rs`` as ``src::a::b``; with ``.`` for languages whose modules are written with dots."""
    stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
    return stem.strip("/").replace("/", separator)


_PARTS = re.compile(r"::|\.")


def last_part(name: str) -> str:
    """What follows the last ``::`` or ``.``."""
    return _PARTS.split(name)[-1] if ":" in name else name.rsplit(".", 1)[-1]


def adapters(features: tuple[str, ...] = ()) -> dict[str, Adapter]:
    """By language. ``features``: those that conditional code is compiled with."""
    from graphloom.sources import manifests, markup, python_code, scanners

    return {
        "python": python_code.extract, "jupyter": markup.notebook, "markdown": markup.markdown, "xml": manifests.android, "toml": manifests.cargo,
        **{k: (lambda path, text, k=k: scanners.extract(k, path, text, features)) for k in ("rust", "kotlin", "swift", "fsharp", "mojo")},
    }


def by_file_name(path: str) -> Adapter | None:
    """The adapter of a build file, which goes by its name and not by its language."""
    from graphloom.sources import manifests

    name = path.rsplit("/", 1)[-1]
    if name == "Cargo.lock":
        return manifests.cargo
    if name in ("build.gradle", "build.gradle.kts"):
        return manifests.gradle
    if name == "pom.xml":
        return manifests.pom
    if name == "Package.swift":
        return manifests.swift_package
    if name == "paket.references":
        return lambda path, text: (Fact("dependency", x, path, "paket-reference") for x in manifests.paket_references(text))
    if name == "paket.dependencies":
        return lambda path, text: (Fact("dependency", k, path, "paket", v or None) for k, v in manifests.paket(text).items())
    if name.endswith(".sln"):
        return lambda path, text: (Fact("package", x, path, "member") for x in manifests.solution(text))
    return manifests.fsproj if name.endswith(".fsproj") else None


def extract(files: DataFrame, known: dict[str, Adapter] | None = None, features: tuple[str, ...] = ()) -> DataFrame:
    """Facts of all files. ``files``: path, language, content (binary or string)."""
    schema = pa.schema([("path", pa.string()), ("fact", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("kind", pa.string()), ("target", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("ordering", pa.int64()), ("detail", pa.map_(pa.string(), pa.string()))])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_language = known or adapters(features)
        for batch in batches:
            rows: list[tuple] = []
            for path, language, content in ((c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                adapter = by_file_name(path) or by_language.get(language)
                if adapter is None or content is None:
                    continue
                try:
                    facts = list(adapter(path, content.decode("utf-8")))
                except (SyntaxError, ValueError, RecursionError, LookupError, TypeError, AttributeError) as e:  # UnicodeDecodeError is a ValueError; the others: fields of unexpected form
                    line = getattr(e, "lineno", None) or 0
                    facts = [Fact("diagnostic", type(e).__name__, kind=language, target=str(e)[:500], start_line=line, end_line=line)]
                rows += [(path, f.fact, f.name, f.qualified_name, f.kind, f.target, f.start_line, f.end_line, f.ordering, list(f.detail.items())) for f in facts]
                if len(rows) >= AT_ONCE:
                    yield as_batch(rows)
                    rows = []
            yield as_batch(rows)

    ship(files.sparkSession)
    return files.select("path", "language", F.col("content").cast("binary")).mapInArrow(run, SCHEMA)


def symbols_of(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'symbol'").select("path", "name", "qualified_name", "kind", "start_line", "end_line")


def edges_of(facts: DataFrame) -> DataFrame:
    """Unresolved edges by kind, one a source, target, kind and place; confidence by how much of the target is known."""
    kinds = {"call": "Calls", "import": "Imports", "type": "ReferencesType", "base": "Extends", "decorator": "ModifiedWith", "spawn": "Spawns", "send": "SendsTo", "link": "ConfiguredBy", "test": "TestedBy"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("fact"))
    kind = F.when((F.col("fact") == "base") & (F.element_at("detail", "implements") == "true"), "Implements").otherwise(kind)
    # A test is linked with what its name is made of. In one pass: facts are made anew in each.
    test = F.col("fact") == "test"
    named = F.when(test & (F.col("kind") != "Fixture"), similarity_target(F.col("name")))
    confidence = F.when(test, 0.8).otherwise(F.coalesce(F.element_at("detail", "confidence").cast("double"), F.lit(1.0)))
    facts = facts.withColumn("target", F.when(test, named).otherwise(F.col("target"))).filter("fact <> 'test' or target is not null")
    return facts.filter(F.col("fact").isin(*kinds)).select("path", F.col("qualified_name").alias("source"), F.col("target").alias("unresolved_target"), kind.alias("kind"), confidence.alias("confidence"), "ordering").dropDuplicates(["path", "source", "unresolved_target", "kind", "ordering"])
