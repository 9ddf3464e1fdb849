"""Lookups over symbols and edges. Each takes the fact tables and returns all targets at once, or one name's rows.

A name that contains ``::`` is qualified and matches a target's qualified or unresolved name; a simple name also matches the
symbol's own name and the last ``::`` or ``.`` segment of an unresolved target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T


def named_edges(g, *kinds: str, edges: DataFrame | None = None) -> DataFrame:
    """Edges of some kinds with source and target names, kinds and paths. The two symbol joins go by id.

    ``edges``: those edges, narrowed before the joins.
    """
    edges = g.edges.filter(F.col("kind").isin(*kinds)) if edges is None else edges
    edges = edges.withColumnRenamed("kind", "edge_kind")
    files = g.files.select(F.col("id").alias("file"), "path", "repository_id")

    def side(p: str) -> DataFrame:
        s = g.symbols.join(files, F.col("file_id") == F.col("file"))
        return s.select(F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), F.col("qualified_name").alias(f"{p}_qname"), F.col("kind").alias(f"{p}_kind"), F.col("path").alias(f"{p}_path"), F.col("repository_id").alias(f"{p}_repo"))

    return edges.join(side("source"), F.col("source_symbol_id") == F.col("source_id")).join(side("target"), F.col("target_symbol_id") == F.col("target_id"), "left")


def edges_at(g, kinds: tuple[str, ...], symbols: DataFrame, column: str) -> DataFrame:
    """Edges of some kinds with a symbol of ``symbols`` at one end. The semi-join goes below the edges' aggregation."""
    return g.edges.filter(F.col("kind").isin(*kinds)).join(symbols.select(F.col("id").alias("at_id")), F.col(column) == F.col("at_id"), "left_semi")


def edges_to_name(g, name: str, kinds: tuple[str, ...]) -> DataFrame:
    """Edges whose resolved or unresolved target a name stands for, found before any names are joined."""
    hit = g.symbols.filter(symbol_has(name)).select(F.col("id").alias("hit_id"))
    text = F.col("unresolved_target") == name
    if "::" not in name:  # suffix tests on lower case, as the pattern match ignores ASCII case
        text = text | F.lower("unresolved_target").endswith("::" + name.lower()) | F.lower("unresolved_target").endswith("." + name.lower())
    edges = g.edges.filter(F.col("kind").isin(*kinds) & (F.col("target_symbol_id").isNotNull() | text))
    found = edges.join(hit, F.col("target_symbol_id") == F.col("hit_id"), "left")  # one pass over the edges for either kind of target
    return found.filter(F.col("target_symbol_id").isNull() | F.col("hit_id").isNotNull()).drop("hit_id")


def symbol_has(name: str) -> Column:
    return (F.col("qualified_name") == name) if "::" in name else (F.col("name") == name) | (F.col("qualified_name") == name)


def last_segment(c: Column) -> Column:
    """What follows the last ``::`` or ``.``."""
    return F.regexp_extract(c, r"([^.:]*)$", 1)


def target_label() -> Column:
    return F.coalesce("target_qname", "unresolved_target")


def sources_of(g, name: str, *kinds: str) -> DataFrame:
    """Distinct sources of edges to a name: callers, referencers, decorated symbols, tests."""
    hit = named_edges(g, edges=edges_to_name(g, name, kinds))
    return hit.select("source_qname", "source_kind", "source_path", "confidence").distinct()


def targets_of(g, name: str, *kinds: str, distinct: bool = False) -> DataFrame:
    """Targets of edges from a name, one row an edge unless ``distinct``: callees, types, decorators, dependencies."""
    edges = edges_at(g, kinds, g.symbols.filter(symbol_has(name)), "source_symbol_id")
    out = named_edges(g, edges=edges).select(target_label().alias("target"), "target_kind", "target_path", "confidence")
    return out.distinct() if distinct else out


def caller_counts(g, kind: str = "Calls") -> DataFrame:
    """Distinct sources of every resolved target."""
    out = named_edges(g, kind).filter("target_id is not null").groupBy("target_qname").agg(F.countDistinct("source_qname").alias("n_callers"))
    return out


def imports_of_file(g, path: str) -> DataFrame:
    """Imports of any symbol of a file, not distinct."""
    home = g.symbols.join(g.files.filter(F.col("path") == path).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    hit = named_edges(g, edges=edges_at(g, ("Imports",), home, "source_symbol_id"))
    return hit.select("source_qname", target_label().alias("target"), "target_path")


def imported_by(g, path: str) -> DataFrame:
    """Distinct importers of a file's module."""
    home = g.symbols.filter("kind = 'Module'").join(g.files.filter(F.col("path") == path).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    hit = named_edges(g, edges=edges_at(g, ("Imports",), home, "target_symbol_id"))
    return hit.select("source_qname", "source_path").distinct()


def symbol_by_qualified_name(g) -> DataFrame:
    """At most one symbol a repository and qualified name: files that aren't xml first, then the least id."""
    first = F.min(F.struct(F.coalesce(F.col("language") == "xml", F.lit(False)).alias("xml"), "id", "kind")).alias("b")
    return _placed(g).groupBy("repository_id", "qualified_name").agg(first).select("repository_id", "qualified_name", "b.id", "b.kind")


def _placed(g) -> DataFrame:
    """Symbols with their file's repository, language and path."""
    return g.symbols.join(g.files.select(F.col("id").alias("file"), "repository_id", "language", "path"), F.col("file_id") == F.col("file")).drop("file")


def symbols_by_name(g, name: str) -> DataFrame:
    return g.symbols.filter(F.col("name") == name).select("id", "qualified_name", "kind", "file_id")


def start_symbols(g, name: str) -> DataFrame:
    """Symbols that a name stands for: the qualified one if there is one (of a file that isn't xml first), else all of that simple name."""
    exact = g.symbols.limit(0).select("id", "qualified_name", "kind")
    if "::" in name or "." in name:
        xml = F.coalesce(F.col("language") == "xml", F.lit(False))
        exact = _placed(g).filter(F.col("qualified_name") == name).orderBy(xml, "id").limit(1).select("id", "qualified_name", "kind")
    simple = symbols_by_name(g, name).select("id", "qualified_name", "kind")
    return exact.unionByName(simple.join(exact.select(F.lit(1).alias("hit")).limit(1), F.lit(True), "left_anti"))


def fuzzy_find(g, name: str) -> DataFrame:
    """Start symbols, or else those whose name or qualified name contains the text, without regard to case."""
    exact = start_symbols(g, name)
    pattern = f"%{T.escape_like(name)}%"
    like = g.symbols.filter(F.col("name").ilike(pattern) | F.col("qualified_name").ilike(pattern)).select("id", "qualified_name", "kind")
    return exact.unionByName(like.join(exact.select(F.lit(1).alias("hit")).limit(1), F.lit(True), "left_anti"))


def docs_for_symbols(g) -> DataFrame:
    """Docs joined to their symbols."""
    s = g.symbols.select(F.col("id").alias("symbol_id"), "qualified_name")
    return g.docs.join(s, "symbol_id").select(F.col("id").alias("doc_id"), "qualified_name", "title")


def edge_exists(g, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (source, target, unresolved, kind) that are edges; absent targets are equal."""
    e = g.edges.select(F.col("source_symbol_id").alias("s"), F.col("target_symbol_id").alias("t"), F.col("unresolved_target").alias("u"), F.col("kind").alias("k"))
    same = (F.col("source_symbol_id") == F.col("s")) & F.col("target_symbol_id").eqNullSafe(F.col("t")) & F.col("unresolved_target").eqNullSafe(F.col("u")) & (F.col("kind") == F.col("k"))
    return wanted.join(e, same, "left_semi")


def topology(g, kinds: tuple[str, ...] = ("Spawns", "SendsTo")) -> DataFrame:
    rows = named_edges(g, *kinds)
    return rows.select("source_qname", "edge_kind", F.coalesce("target_qname", "unresolved_target", F.lit("unknown")).alias("target"))


def subtree(rows: DataFrame, qname_col: str, root: str) -> DataFrame:
    """Rows of a symbol and of what lies under it after ``::``."""
    return rows.filter((F.col(qname_col) == root) | F.col(qname_col).startswith(root + "::"))


def model_dependencies(g, models: DataFrame) -> DataFrame:
    """Type references of models whose target is a model itself."""
    refs = named_edges(g, "ReferencesType").filter("target_qname is not null")
    names = models.select(F.col("qualified_name").alias("m"))
    return refs.join(names, F.col("source_qname") == F.col("m"), "left_semi").join(names, F.col("target_qname") == F.col("m"), "left_semi").select("source_qname", "target_qname").distinct()


def routes_with_dependencies(routes: DataFrame, g) -> DataFrame:
    """Routes with the number of what their handlers are configured by, in order of path and method."""
    deps = named_edges(g, "ConfiguredBy").select("source_qname", target_label().alias("dep")).distinct()
    return routes.join(deps, routes.qualified_name == deps.source_qname, "left").groupBy("path", "method", "qualified_name").agg(F.count("dep").alias("n_deps")).orderBy("path", "method")


def repository_by_root(g, root: str) -> DataFrame:
    return g.repositories.filter(F.col("root_path") == root)


def file_by_path(g, path: str) -> DataFrame:
    """The files of a path, one a repository at most."""
    return g.files.filter(F.col("path") == path)


def symbols_of_file(g, path: str) -> DataFrame:
    own = file_by_path(g, path).select(F.col("id").alias("file_id"))
    return g.symbols.join(own, "file_id", "left_semi").select("id", "name", "qualified_name", "kind", "start_line").orderBy("start_line", "id")


def symbol_by_id(g, symbol_id: int) -> DataFrame:
    return g.symbols.filter(F.col("id") == symbol_id)


def tests_of_file(g, path: str) -> DataFrame:
    own = file_by_path(g, path).select(F.col("id").alias("file_id"))
    return g.tests.join(own, "file_id", "left_semi").select("id", "name", "qualified_name", "kind").orderBy("qualified_name")
