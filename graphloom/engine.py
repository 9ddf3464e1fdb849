"""One method a command: a thin front over the operators, for any object with the fact tables as attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import context, coverage, graph, history, incremental, relations, resolve, search
from graphloom.schema import CONTEXT_KINDS, SCHEMAS
from graphloom.sources.repo import read_file
from graphloom.sources.store import INDEXED


class Engine:
    """Queries over a graph: ``sources.store.StoredGraph`` of an indexed repository, or any object with such attributes.

    Targets that nothing is known of give no rows.
    """

    def __init__(self, g):
        self.g = g

    def files(self) -> DataFrame:
        return self.g.files.orderBy("path", "id")

    def symbols(self) -> DataFrame:
        return self.g.symbols

    def find(self, name: str) -> DataFrame:
        return relations.fuzzy_find(self.g, name)

    def callers(self, name: str) -> DataFrame:
        return relations.sources_of(self.g, name, "Calls")

    def callees(self, name: str) -> DataFrame:
        return relations.targets_of(self.g, name, "Calls")

    def imports(self, path: str) -> DataFrame:
        return relations.imports_of_file(self.g, path)

    def imported_by(self, path: str) -> DataFrame:
        return relations.imported_by(self.g, path)

    def types(self, name: str) -> DataFrame:
        return relations.targets_of(self.g, name, "ReferencesType")

    def decorators(self, name: str) -> DataFrame:
        return relations.targets_of(self.g, name, "ModifiedWith")

    def tests(self, name: str) -> DataFrame:
        return relations.sources_of(self.g, name, "TestedBy")

    def test_deps(self, name: str) -> DataFrame:
        return relations.targets_of(self.g, name, "TestedBy", distinct=True)

    def fixtures(self, name: str) -> DataFrame:
        return relations.targets_of(self.g, name, "ConfiguredBy", distinct=True)

    def docs(self, name: str) -> DataFrame:
        return relations.docs_for_symbols(self.g).filter(F.col("qualified_name") == name)

    def _searched(self, name: str, query: str) -> DataFrame:
        """By the graph's index, if it has one, else over its texts."""
        rows, index = getattr(self.g, name), self.g.text_index(name) if hasattr(self.g, "text_index") else None
        return search.search(rows, "id", query, *INDEXED[name]) if index is None else index.search(rows, "id", query)

    def doc_search(self, query: str) -> DataFrame:
        return self._searched("docs", query)

    def search(self, query: str) -> DataFrame:
        """Symbols and docs, each ranked, or by substring where nothing is ranked."""
        one = lambda name, kind: self._searched(name, query).select(F.lit(kind).alias("type"), F.col("doc").alias("id"), "score")
        return one("symbols", "symbol").unionByName(one("docs", "doc"))

    def impact(self, name: str, depth: int = 2) -> DataFrame:
        return graph.impact(self.g, relations.start_symbols(self.g, name), depth)

    def context(self, name: str) -> DataFrame:
        return graph.neighbourhood(self.g, relations.start_symbols(self.g, name))

    def cochange(self, item) -> DataFrame:
        """What changes together with a file, or with a symbol (of several of a simple name, that of the least id), the most often first."""
        items = self.g.commit_files
        if isinstance(item, str) and not self._is_path(item):
            items = self.g.commit_symbols
            first = relations.start_symbols(self.g, item).orderBy("id").first()
            item = first.qualified_name if first else item
        return history.cochange_of(items, item).orderBy(F.desc("n_together"), "b")

    def _is_path(self, item: str) -> bool:
        """A file that is indexed, or a name that looks like one."""
        return "/" in item or "\\" in item or item.endswith((".py", ".rs", ".md", ".toml", ".json")) or not self.g.files.filter(F.col("path") == item).isEmpty()

    def git(self, item) -> DataFrame:
        return history.git_metadata(self.g.commit_files.filter(F.col("item") == item), self.g.commits)

    def resolve(self) -> DataFrame:
        return resolve.resolve_edges(self.g)

    def topology(self) -> DataFrame:
        return relations.topology(self.g)

    def status(self) -> DataFrame:
        """Rows of every fact table."""
        return incremental.row_counts({n: self.g.table(n) for n in SCHEMAS})

    def show(self, name: str) -> DataFrame:
        """The symbol of a qualified name (files that aren't xml first, then the least id), its provenance and its lines of source."""
        files = self.g.files.select(F.col("id").alias("file_id"), "repository_id", "path", "language")
        roots = self.g.repositories.select(F.col("id").alias("repository_id"), "root_path")
        hit = self.g.symbols.filter(F.col("qualified_name") == name).join(files, "file_id").join(roots, "repository_id")
        hit = hit.orderBy(F.when(F.col("language") == "xml", 1).otherwise(0), "id").limit(1)
        hit = hit.join(self.g.generated_symbols.withColumnRenamed("symbol_id", "id"), "id", "left").select("name", "qualified_name", "kind", "path", "start_line", "end_line", "provenance", "root_path")
        row = hit.first()
        if row is None or row.path.startswith("external:"):
            return hit.drop("root_path").withColumn("source", F.lit(None).cast("string"))
        text = read_file(hit.sparkSession, row.root_path, row.path).select(F.col("content").cast("string").alias("text"))
        return hit.drop("root_path").join(text, F.lit(True), "left").withColumn("source", T.source_slice(F.col("text"), F.col("start_line").cast("int"), F.col("end_line").cast("int"))).drop("text")

    def routes(self) -> DataFrame:
        return relations.routes_with_dependencies(self.g.routes, self.g)

    def model(self, name: str) -> DataFrame:
        """Fields of the models of a simple or qualified name."""
        hit = self.g.models.filter((F.col("name") == name) | (F.col("qualified_name") == name)).select(F.col("id").alias("model_id"), "qualified_name")
        return hit.join(self.g.model_fields, "model_id", "left").select("qualified_name", "name", "type_annotation", "default_value", "is_required")

    def model_dependencies(self, name: str) -> DataFrame:
        hit = self.g.models.filter((F.col("name") == name) | (F.col("qualified_name") == name)).select(F.col("qualified_name").alias("source_qname"))
        return relations.model_dependencies(self.g, self.g.models).join(hit, "source_qname", "left_semi")

    def pipeline(self, name: str) -> DataFrame:
        """What the callers of a name call, in order: the target, the steps before it, and those after, which fail with it."""
        callers = relations.edges_to_name(self.g, name, ("Calls",)).select(F.col("source_symbol_id").alias("id")).distinct()
        calls = relations.named_edges(self.g, edges=relations.edges_at(self.g, ("Calls",), callers, "source_symbol_id"))
        label = relations.target_label()
        calls = calls.select("source_qname", "ordering", relations.last_segment(label).alias("name"), label.alias("label"))
        target = F.col("label") == name if "::" in name else F.col("name") == relations.last_segment(F.lit(name))
        return graph.pipeline_steps(calls, "source_qname", "ordering", "name", target)

    def concurrency(self, name: str) -> DataFrame:
        """Spawns and channel ends in a symbol and in what lies under it, in order of lines."""
        spawns = relations.subtree(self.g.spawns, "symbol_qualified_name", name).select(F.col("symbol_qualified_name").alias("scope"), F.lit("spawn").alias("what"), "kind", F.lit(None).cast("string").alias("identity"), "line")
        ends = relations.subtree(self.g.channels, "scope", name).select("scope", F.col("role").alias("what"), "kind", "identity", "line")
        return spawns.unionByName(ends).orderBy("line", "scope", "what")

    def safety(self, target: str) -> DataFrame:
        """Score and risk by file, of a file's path or of a symbol and what lies under it; the target's rows are taken before blocks are placed."""

        def of(df: DataFrame) -> DataFrame:
            known = df.join(self.g.files.select(F.col("id").alias("file_id"), "path"), "file_id")
            return known.filter((F.col("path") == target) | (F.col("symbol_qualified_name") == target) | F.col("symbol_qualified_name").startswith(target + "::"))

        blocks = of(self.g.unsafe_blocks).select("path", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
        functions = of(self.g.unsafe_functions).select("path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
        return coverage.safety_profile(blocks, functions, of(self.g.ffi_bindings).select("path"), "path")

    def coverage(self, target: str) -> DataFrame:
        """Of a file's path: lines that can be and are covered, over all suites. Of a qualified name: by suite."""
        files = self.g.files.filter(F.col("path") == target).select(F.col("id").alias("file_id"))
        symbols = self.g.symbols.filter(F.col("qualified_name") == target).select("file_id", F.col("qualified_name").alias("symbol"), "start_line", "end_line")
        if files.isEmpty():
            return coverage.symbol_coverage(self.g.coverage.join(symbols.select("file_id"), "file_id", "left_semi"), symbols)
        return coverage.coverage_profile(self.g.coverage.join(files, "file_id", "left_semi"))

    def coverage_sets(self, target: str) -> DataFrame:
        """Of a file's path or a qualified name: the lists of lines that can be, are and aren't covered, over all reports and suites."""
        lines = self.g.line_coverage.select("file_id", F.coalesce("report_path", F.lit("")).alias("report"), F.coalesce("test_suite", F.lit("")).alias("suite"), "line", "hits")
        files = self.g.files.filter(F.col("path") == target).select(F.col("id").alias("file_id"))
        if not files.isEmpty():
            return coverage.line_sets(lines.join(files, "file_id", "left_semi"))
        symbols = self.g.symbols.filter(F.col("qualified_name") == target).select("file_id", F.col("qualified_name").alias("symbol"), "start_line", "end_line")
        return coverage.symbol_line_sets(lines.join(symbols.select("file_id"), "file_id", "left_semi"), symbols)

    def uncovered(self, path: str) -> DataFrame:
        """Runs of uncovered lines of a file, by suite."""
        files = self.g.files.filter(F.col("path") == path).select(F.col("id").alias("file_id"))
        return coverage.uncovered_spans(self.g.coverage.join(files, "file_id", "left_semi")).select("suite", "first_line", "last_line").orderBy("suite", "first_line")

    def workspace(self) -> DataFrame:
        return self.g.packages.select("name", "manifest_path", "version").orderBy("name", "manifest_path")

    def deps(self, package: str) -> DataFrame:
        """Dependencies of the packages of a name."""
        own = self.g.packages.filter(F.col("name") == package).select(F.col("id").alias("package_id"))
        return self.g.dependencies.join(own, "package_id", "left_semi").drop("package_id").orderBy("name")

    def android_components(self) -> DataFrame:
        return self.g.android_components.orderBy("name")

    def android_resources(self) -> DataFrame:
        return self.g.android_resources.orderBy("name", "type")

    def resource_references(self, qualified_name: str) -> DataFrame:
        """Distinct sources of edges of any kind into a resource, in any repository."""
        at = self.g.symbols.filter(F.col("qualified_name") == qualified_name).select(F.col("id").alias("at_id"))
        edges = self.g.edges.join(at, F.col("target_symbol_id") == F.col("at_id"), "left_semi")
        return relations.named_edges(self.g, edges=edges).select("source_qname", "source_path").distinct()

    def pack(self, name: str, budget: int | None = None) -> DataFrame:
        """A context pack: the target with its docs and tests, its edges, and the symbols beside it with theirs, within a budget of tokens.

        ``target, section, position, item, tokens``; sections are numbered as in ``operators.context.SECTIONS``.
        """
        g = self.g
        start = relations.start_symbols(g, name).select("id").distinct()
        beside = graph.neighbourhood(g, start).filter("depth > 0").select("id")
        names = g.symbols.select("id", "qualified_name")
        near = g.edges.filter(F.col("kind").isin(*CONTEXT_KINDS))
        at = start.select(F.col("id").alias("at_id"))
        out = near.join(at, F.col("source_symbol_id") == F.col("at_id"), "left_semi")
        into = near.join(at, F.col("target_symbol_id") == F.col("at_id"), "left_semi")
        edges = relations.named_edges(g, edges=out.unionByName(into).distinct()).select(F.concat_ws(" ", "source_qname", "edge_kind", relations.target_label()).alias("item"))

        def symbols(ids: DataFrame) -> DataFrame:
            return names.join(ids, "id", "left_semi").select(F.col("qualified_name").alias("item"))

        def docs(ids: DataFrame) -> DataFrame:
            own = g.docs.join(ids.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_semi")
            return own.select(F.concat_ws(": ", "title", "body").alias("item"))

        def tests(ids: DataFrame) -> DataFrame:
            links = g.edges.filter("kind = 'TestedBy'").join(ids.select(F.col("id").alias("at_id")), F.col("target_symbol_id") == F.col("at_id"), "left_semi")
            return symbols(links.select(F.col("source_symbol_id").alias("id")))

        items = None
        for section, rows in enumerate((symbols(start), docs(start), tests(start), edges, symbols(beside), docs(beside), tests(beside))):
            rows = rows.distinct().select(F.lit(name).alias("target"), F.lit(section).alias("section"), F.lit(0).alias("position"), "item", search.estimate_tokens(F.col("item")).alias("tokens"))
            items = rows if items is None else items.unionByName(rows)
        return context.pack(items, budget)
