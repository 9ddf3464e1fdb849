"""From a repository to fact tables: scan, diff, extract what changed, resolve, link, history, coverage.

Ids are 64-bit hashes of natural keys, so they need no counter, are the same in every run and can be computed on either side
of a join. Two keys with one id (one chance in 2^64 a pair) are looked for and end the run instead of being merged.

Only changed files are parsed. What the adapters said is kept as a table, and edges are resolved anew from it in each run, as a new
symbol can make an old name resolvable or ambiguous anywhere.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import coverage, incremental, matching, resolve
from graphloom.operators.relations import last_segment
from graphloom.sources import facts as sources
from graphloom.sources import repo, report_lines
from graphloom.sources.store import INDEXED, FactStore, Run

#: Rows of git's output that are turned into a DataFrame at once.
PATCH_ROWS = 500_000


class _View:
    """Tables under the names that the operators expect."""

    def __init__(self, **tables: DataFrame):
        self.__dict__.update(tables)


def key(*parts: str | Column) -> Column:
    """The id of a natural key."""
    return F.xxhash64(*parts)


def _distinct_ids(df: DataFrame, table: str, *parts: str) -> None:
    """End the run if two keys have one id."""
    clash = df.groupBy("id").agg(F.countDistinct(*parts).alias("n")).filter("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"two rows of {table} have the id {clash[0]['id']}")


def index(spark: SparkSession, root: str, store: FactStore, ignored: list[str] | None = None, force: bool = False, history: bool = False, limit: int = 0, features: tuple[str, ...] = ()) -> DataFrame:
    """Index the files under ``root`` into ``store``; returns the number of files by status (new, changed, unchanged, deleted).

    ``force`` parses all files again (as it must when the active ``features`` of conditional code change). ``history`` reads ``git log`` of a local clone (its last ``limit`` commits, 0: all). An
    empty folder gives empty tables; a file that can't be parsed gives a diagnostic and no symbols.
    """
    began, root = _now(), root.rstrip("/")
    try:
        return _index(spark, root, store, began, ignored, force, history, limit, features)
    except Exception as e:
        _failed(spark, root, store, began, f"{type(e).__name__}: {e}"[:2000])
        raise


def _failed(spark: SparkSession, root: str, store: FactStore, began: str, message: str) -> None:
    """A row of a run that failed; all other tables stay as they were."""
    run = store.begin()
    entry = [(run.number, began, _now(), "failed", message)]
    one = spark.createDataFrame(entry, "id long, started_at string, finished_at string, status string, error_message string").withColumn("repository_id", key(F.lit(root)))
    run.write("index_runs", run.old("index_runs").unionByName(one, allowMissingColumns=True))
    run.finish()


def _index(spark: SparkSession, root: str, store: FactStore, began: str, ignored: list[str] | None, force: bool, history: bool, limit: int, features: tuple[str, ...]) -> DataFrame:
    run, repo_id = store.begin(), key(F.lit(root))
    run.write("repositories", spark.range(1).select(repo_id.alias("id"), F.lit(root).alias("root_path"), F.lit("git").alias("vcs_type")))
    found = repo.discover(spark, root, ignored)
    listed = run.stage("listing", found.drop("content"))
    known = run.old("files").filter(~F.col("path").startswith("external:")).select("path", "content_hash")
    changes = run.stage("changes", incremental.diff(listed.select("path", "content_hash"), known.limit(0) if force else known))
    said = _facts(run, found, changes, features)
    _files_and_edges(run, root, listed, said)
    _details(run, root, said)
    if history:
        _history(spark, run, root, limit)
    summary = spark.createDataFrame([tuple(r) for r in incremental.run_summary(changes).collect()], "status string, n_files long")  # four rows at most
    n = {r.status: r.n_files for r in summary.collect()}
    entry = (run.number, n.get("new", 0) + n.get("changed", 0) + n.get("unchanged", 0), n.get("new", 0) + n.get("changed", 0), n.get("deleted", 0), began, _now(), "completed")
    one = spark.createDataFrame([entry], "id long, files_scanned long, files_changed long, files_deleted long, started_at string, finished_at string, status string")
    run.write("index_runs", run.old("index_runs").unionByName(one.withColumn("repository_id", repo_id), allowMissingColumns=True))
    run.finish()
    for name in INDEXED:
        store.refresh_index(name)
    return summary


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _facts(run: Run, found: DataFrame, changes: DataFrame, features: tuple[str, ...] = ()) -> DataFrame:
    """Old facts of unchanged files and new ones of the others. Changed paths are the small side of the join with contents."""
    todo = changes.filter("status in ('new', 'changed')").select("path")
    kept = run.old("facts").join(changes.filter("status = 'unchanged'").select("path"), "path", "left_semi")
    fresh = sources.extract(found.join(todo, "path", "left_semi"), features=features)
    return run.write("facts", kept.unionByName(fresh).sortWithinPartitions("fact", "path"))


def _symbols(root: str, listed: DataFrame, said: DataFrame) -> DataFrame:
    """One symbol a file and qualified name, the last written: declared ones, resources, and drawables by their place."""
    declared = said.filter("fact = 'symbol'").select("path", "name", "qualified_name", "kind", "start_line", "end_line")
    none = F.lit(0).cast("long")
    resources = said.filter("fact = 'resource' and qualified_name <> ''").select("path", "name", "qualified_name", F.lit("Unknown").alias("kind"), none.alias("start_line"), none.alias("end_line"))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^/]*)?$", 1)
    drawn = listed.filter(F.col("path").rlike(r"(?:^|/)res/drawable[^/]*/[^/]+$")).select("path", stem.alias("name"), F.concat(F.lit("R.drawable."), stem).alias("qualified_name"), F.lit("Unknown").alias("kind"), none.alias("start_line"), none.alias("end_line"))
    rows = declared.unionByName(resources).unionByName(drawn).withColumn("file_id", key(F.lit(root), "path"))
    last = F.max(F.struct("start_line", "end_line", "kind", "name")).alias("s")
    rows = rows.groupBy("file_id", "qualified_name").agg(last).select("file_id", "qualified_name", "s.*")
    return rows.withColumn("id", key("file_id", "qualified_name"))


def _packages(root: str, said: DataFrame) -> DataFrame:
    rows = said.filter("fact = 'package'").groupBy("path", "name", "kind").agg(F.max("target").alias("version"))
    return rows.withColumn("id", key(F.lit(root), "name", "path")).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))


def _dependencies(packages: DataFrame, said: DataFrame) -> DataFrame:
    """Dependencies by the package of their own manifest.

    A member that inherits one has the workspace's requirement and the features of both; a version in a lock file goes before
    either. A project that takes names from a shared list has those in its own folder's references, with the list's versions.
    """
    features = F.filter(F.coalesce(F.split(F.col("detail")["features"], ","), F.array().cast("array<string>")), lambda x: x != "")
    rows = said.filter("fact = 'dependency'").select("path", "name", "kind", "target", features.alias("features"), F.coalesce(F.col("detail")["workspace"] == "true", F.lit(False)).alias("inherits"))
    rows = rows.withColumn("folder", F.regexp_replace("path", r"/?[^/]*$", ""))
    real = packages.filter("kind not in ('locked', 'member')").select("path", F.col("dir").alias("folder"), F.col("kind").alias("sort"), F.col("id").alias("package_id"))
    listed = rows.filter("kind = 'paket'").groupBy("name").agg(F.max("target").alias("listed"))
    taken = rows.filter("kind = 'paket-reference'").join(real.filter("sort = 'fsharp'").select("folder", "package_id"), "folder").join(listed, "name", "left").withColumn("target", F.col("listed"))
    own = rows.filter("kind not in ('workspace', 'paket', 'paket-reference')").join(real.select("path", "package_id"), "path")
    columns = ["package_id", "name", "kind", "target", "features", "inherits"]
    own = own.select(*columns).unionByName(taken.select(*columns)).groupBy("package_id", "name").agg(
        F.max("target").alias("requirement"), F.max("inherits").alias("inherits"), F.array_distinct(F.flatten(F.collect_set("features"))).alias("features"), F.min(F.col("kind") == "dev").alias("is_dev"))
    shared = rows.filter("kind = 'workspace'").groupBy("name").agg(F.max("target").alias("requirement"), F.array_distinct(F.flatten(F.collect_set("features"))).alias("more"))
    locked = packages.filter("kind = 'locked'").groupBy("name").agg(F.max("version").alias("version"))
    found = matching.inherited_dependencies(own.select(F.col("package_id").alias("package"), "name", "requirement", "inherits"), shared, locked)
    found = found.select(F.col("package").alias("package_id"), "name", F.col("requirement").alias("version_requirement"))
    both = F.when(F.col("inherits"), F.array_union("features", F.coalesce("more", F.array().cast("array<string>")))).otherwise(F.col("features"))
    out = own.drop("requirement").join(found, ["package_id", "name"]).join(shared.select("name", "more"), "name", "left")
    return out.select("package_id", "name", "version_requirement", F.col("inherits").alias("is_workspace_dependency"), F.array_sort(both).alias("features"), "is_dev")


def _files_and_edges(run: Run, root: str, listed: DataFrame, said: DataFrame) -> None:
    """Files, symbols, packages, tests, docs and edges: resolved, then with what lies outside as symbols of their own."""
    spark, repo_id = run.store.spark, key(F.lit(root))
    files = listed.select(key(F.lit(root), "path").alias("id"), repo_id.alias("repository_id"), "path", "language", "content_hash", "line_count")
    symbols = run.stage("symbols", _symbols(root, listed, said))
    packages = run.stage("packages", _packages(root, said))
    run.write("packages", packages.filter("kind not in ('locked', 'member')").select("id", repo_id.alias("repository_id"), "name", F.col("path").alias("manifest_path"), "version", F.lit(True).alias("is_workspace_member")))
    dependencies = run.write("dependencies", _dependencies(packages, said))
    raw = sources.edges_of(said).withColumn("file_id", key(F.lit(root), "path"))
    raw = raw.select(key("file_id", "source").alias("source_symbol_id"), F.lit(None).cast("long").alias("target_symbol_id"), "unresolved_target", "kind", "confidence", F.col("ordering").cast("long").alias("ordering"))
    raw = run.stage("raw", raw.groupBy("source_symbol_id", "target_symbol_id", "unresolved_target", "kind").agg(F.min("confidence").alias("confidence"), F.min("ordering").alias("ordering")))
    first = run.stage("first", resolve.resolve_edges(_View(files=files, symbols=symbols, edges=raw)))
    owned = matching.owning_package(listed.select("path"), packages.filter("kind not in ('locked', 'member')").select(F.col("id").alias("package"), "dir", F.lit(0).alias("position")))
    owners = owned.filter("package is not null").select(key(F.lit(root), "path").alias("file_id"), F.col("package").alias("package_id")).join(symbols.select("file_id", F.col("id").alias("source_symbol_id")), "file_id")
    outside = resolve.resolve_external(first, owners, dependencies).select("external_file", "unresolved_target").distinct()
    outside = run.stage("outside", outside.withColumn("file_id", key(F.lit(root), "external_file")))
    files = run.write("files", files.unionByName(outside.select(F.col("file_id").alias("id"), repo_id.alias("repository_id"), F.col("external_file").alias("path"), F.lit("rust").alias("language")).distinct(), allowMissingColumns=True))
    _distinct_ids(files, "files", "path")
    virtual = outside.select(
        key("file_id", "unresolved_target").alias("id"), "file_id", last_segment(F.col("unresolved_target")).alias("name"), F.col("unresolved_target").alias("qualified_name"),
        F.lit("Unknown").alias("kind"), F.lit(0).cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line"),
    )
    symbols = run.write("symbols", symbols.unionByName(virtual))
    _distinct_ids(symbols, "symbols", "file_id", "qualified_name")
    tests = said.filter("fact = 'test'").withColumn("file_id", key(F.lit(root), "path")).groupBy("file_id", "qualified_name").agg(
        F.max("name").alias("name"), F.max("kind").alias("kind"), F.max(F.coalesce(F.col("detail")["parametrized"] == "true", F.lit(False))).alias("is_parametrized"), F.max(F.col("detail")["framework"]).alias("framework"),
    )
    tests = run.write("tests", tests.withColumn("id", key("file_id", "qualified_name")))
    # The names of what lies outside are exact now; they don't make simple names ambiguous, as those were tried before.
    names = outside.select("unresolved_target", key("file_id", "unresolved_target").alias("outside_id")).groupBy("unresolved_target").agg(F.min("outside_id").alias("outside_id"))
    found = first.join(names, "unresolved_target", "left").withColumn("target_symbol_id", F.coalesce("resolved_id", "outside_id"))
    found = found.select("source_symbol_id", "target_symbol_id", F.when(F.col("target_symbol_id").isNull(), F.col("unresolved_target")).alias("unresolved_target"), "kind", "confidence", "ordering")
    found = run.stage("found", found.groupBy("source_symbol_id", "target_symbol_id", "unresolved_target", "kind").agg(F.min("confidence").alias("confidence"), F.min("ordering").alias("ordering")))
    tested = resolve.direct_call_tests(_View(tests=tests, edges=found)).select("source_symbol_id", "target_symbol_id", F.lit("TestedBy").alias("kind"))
    target = symbols.select(F.col("id").alias("target_symbol_id"), F.col("name").alias("target_name"))
    marks = found.filter("kind = 'ModifiedWith'").join(target, "target_symbol_id", "left").select(F.col("source_symbol_id").alias("symbol_id"), F.coalesce("target_name", last_segment(F.col("unresolved_target"))).alias("mark")).distinct()
    made = run.stage("made", resolve.generated_links(symbols, marks))
    run.write("generated_symbols", made.select(F.col("generated_id").alias("symbol_id"), "kind").groupBy("symbol_id").agg(F.min("kind").alias("provenance")))
    links = tested.unionByName(made.select(F.col("generated_id").alias("source_symbol_id"), F.col("base_id").alias("target_symbol_id"), "kind")).withColumns({"unresolved_target": F.lit(None).cast("string"), "confidence": F.lit(1.0), "ordering": F.lit(None).cast("long")})
    every = found.unionByName(links)
    run.write("edges", every.groupBy("source_symbol_id", "target_symbol_id", "unresolved_target", "kind").agg(F.min("confidence").alias("confidence"), F.min("ordering").alias("ordering")))
    _docs(run, root, said, symbols)


def _docs(run: Run, root: str, said: DataFrame, symbols: DataFrame) -> None:
    """A docstring is its symbol's; a section is that of every symbol with the title's name, one row each, or nobody's."""
    rows = said.filter("fact = 'doc'").select(
        key(F.lit(root), "path").alias("file_id"), F.col("name").alias("title"), F.coalesce("target", F.lit("")).alias("body"), "start_line", "end_line", F.col("kind").alias("source_kind"), "qualified_name",
    ).withColumn("id", key("file_id", "start_line", "source_kind", "qualified_name"))
    strings = rows.filter("source_kind = 'Docstring'").withColumn("symbol_id", key("file_id", "qualified_name"))
    sections = rows.filter("source_kind <> 'Docstring'")
    links = resolve.doc_symbol_links(_View(docs=sections, symbols=symbols)).withColumnRenamed("doc_id", "id")
    linked = sections.join(links, "id", "left").withColumn("id", F.when(F.col("symbol_id").isNull(), F.col("id")).otherwise(key("id", "symbol_id")))
    run.write("docs", strings.unionByName(linked).dropDuplicates(["id"]))


def _details(run: Run, root: str, said: DataFrame) -> None:
    """Routes, models, concurrency, safety and resources: projections of the facts."""
    rows = said.withColumn("file_id", key(F.lit(root), "path")).withColumn("symbol_id", key("file_id", "qualified_name"))
    routes = rows.filter("fact = 'route'").select("file_id", "symbol_id", F.col("name").alias("handler_name"), "qualified_name", F.col("kind").alias("method"), F.col("target").alias("path"), F.col("detail")["response_model"].alias("response_model"))
    run.write("routes", routes.withColumn("id", key("file_id", "qualified_name", "method", "path")).dropDuplicates(["id"]))
    models = rows.filter("fact = 'model'").select(F.col("symbol_id").alias("id"), "file_id", "symbol_id", "name", "qualified_name", "start_line", "end_line")
    run.write("models", models.dropDuplicates(["id"]))
    fields = rows.filter("fact = 'field'").groupBy(F.col("symbol_id").alias("model_id"), "name").agg(
        F.max(F.struct("start_line", F.col("kind").alias("type_annotation"), F.col("target").alias("default_value"), (F.col("detail")["required"] == "true").alias("is_required"))).alias("f"))
    run.write("model_fields", fields.select("model_id", "name", "f.*"))
    checks = rows.filter("fact = 'validator'").groupBy(F.col("symbol_id").alias("model_id"), "name", "kind").agg(F.max("target").alias("fields"))
    run.write("model_validators", checks.select("model_id", "name", "kind", F.filter(F.split(F.coalesce("fields", F.lit("")), ","), lambda x: x != "").alias("fields")))
    qname, line = F.col("qualified_name").alias("symbol_qualified_name"), F.col("start_line").alias("line")
    run.write("spawns", rows.filter("fact = 'spawn'").select("file_id", qname, F.col("kind"), line).distinct())
    channel = rows.filter("fact = 'channel'")
    ends = channel.select(F.col("qualified_name").alias("scope"), "kind", F.col("name").alias("identity"), F.lit("tx").alias("role"), line).unionByName(
        channel.select(F.col("qualified_name").alias("scope"), "kind", F.col("target").alias("identity"), F.lit("rx").alias("role"), line))
    used = rows.filter("fact = 'end'").select(F.col("qualified_name").alias("scope"), F.lit("use").alias("kind"), F.col("name").alias("identity"), F.col("kind").alias("role"), line)
    run.write("channels", ends.unionByName(used).distinct())
    blocks, functions = rows.filter("fact = 'unsafe' and kind = 'block'"), rows.filter("fact = 'unsafe' and kind = 'function'")
    run.write("unsafe_functions", functions.select("file_id", F.concat_ws("::", "qualified_name", "name").alias("symbol_qualified_name"), "start_line", "end_line").distinct())
    inside = coverage.contained(
        blocks.select("file_id", F.col("start_line").alias("start"), F.col("end_line").alias("end")), functions.select("file_id", F.col("start_line").alias("lo"), F.col("end_line").alias("hi")), "file_id",
    ).select("file_id", F.col("start").alias("start_line"), F.lit(False).alias("out")).distinct()
    run.write("unsafe_blocks", blocks.select("file_id", qname, "start_line", "end_line").distinct().join(inside, ["file_id", "start_line"], "left").withColumn("is_wrapped", F.coalesce("out", F.lit(True))))
    run.write("ffi_bindings", rows.filter("fact = 'ffi'").select("file_id", qname, line).distinct())
    resources = rows.filter("fact = 'resource'")
    run.write("android_components", resources.filter("path like '%AndroidManifest.xml'").select("file_id", "kind", "name", F.filter(F.split(F.coalesce("target", F.lit("")), ","), lambda x: x != "").alias("intent_actions")).distinct())
    run.write("android_resources", resources.filter("qualified_name like 'R.%'").select("file_id", F.col("kind").alias("type"), "name", "qualified_name").distinct())


def _patch_rows(root: str, limit: int) -> Iterator[tuple[str, str, int]]:
    """``(commit, path, line)`` touched, from one ``git log`` whose output is read as it comes."""
    command = ["git", "-C", root, "log", "-p", "--unified=0", "--no-color", "--no-ext-diff", "--pretty=format:%x1e%H", *([f"-{limit}"] if limit else [])]
    with subprocess.Popen(command, stdout=subprocess.PIPE, text=True, errors="replace") as p:
        commit = path = None
        patch: list[str] = []
        for text in p.stdout:
            text = text.rstrip("\n")
            if text.startswith(("\x1e", "diff --git ")):
                if commit and path:
                    yield from ((commit, path, n) for n in repo.changed_lines("\n".join(patch)))
                patch, path = [], None
                commit = text[1:] if text.startswith("\x1e") else commit
            elif text.startswith("+++ ") and not patch:
                path = text[6:] if text.startswith("+++ b/") else None
            else:
                patch += [text] if patch or text.startswith("@@") else []
        if commit and path:
            yield from ((commit, path, n) for n in repo.changed_lines("\n".join(patch)))
    if p.returncode:
        raise subprocess.CalledProcessError(p.returncode, command)


def _history(spark: SparkSession, run: Run, root: str, limit: int) -> None:
    """Commits, their files, and the current symbols that enclose a touched line, by a join on file and bucket of lines."""
    commits, changed = repo.git_history(spark, root, limit)
    commits = run.stage("commits", commits.withColumn("commit_id", key(F.lit(root), "commit_hash")))
    run.write("git_commits", commits.withColumn("repository_id", key(F.lit(root))).withColumn("id", F.col("commit_id")))
    by_number = changed.join(commits.select(F.col("id").alias("number"), F.col("commit_id").alias("c")), F.col("commit_id") == F.col("number"))
    run.write("git_commit_files", by_number.select(F.col("c").alias("commit_id"), F.col("item").alias("file_path")).distinct())
    lines, part, k = None, [], 0
    schema = "commit string, path string, line long"

    def flush() -> None:
        nonlocal lines, part, k
        df = run.stage(f"patch{k}", spark.createDataFrame(part, schema))
        lines, part, k = df if lines is None else lines.unionByName(df), [], k + 1

    for row in _patch_rows(root, limit):
        part.append(row)
        if len(part) == PATCH_ROWS:
            flush()
    if part or lines is None:
        flush()
    touched = lines.select(key(F.lit(root), "commit").alias("commit_id"), key(F.lit(root), "path").alias("file_id"), "line").distinct()
    symbols = run.store.table("symbols", run.written).select("file_id", F.col("qualified_name").alias("symbol"), "start_line", "end_line")
    run.write("git_commit_symbols", coverage.lines_in_intervals(touched, symbols).select("commit_id", F.col("symbol").alias("symbol_qualified_name")).distinct())


def import_coverage(spark: SparkSession, report: str, store: FactStore, suite: str | None = None) -> None:
    """Read coverage reports (LCOV or Cobertura; a file or folder), match their paths to indexed files, and replace older rows of the
    same report and suite. Lines of files that aren't indexed are left out."""
    run = store.begin()
    rows = run.stage("lines", report_lines.read(spark, report, suite))
    files = run.old("files").filter(~F.col("path").startswith("external:"))
    known = matching.suffix_match(rows.select("path").distinct(), files.select("path"))
    ids = known.join(files.select(F.col("path").alias("known"), F.col("id").alias("file_id")), "known").select(F.col("reported").alias("path"), "file_id")
    fresh = rows.join(ids, "path").groupBy("file_id", "report_path", F.col("suite").alias("test_suite"), "line").agg(F.max("hits").alias("hits"), F.max("branches_valid").alias("branches_valid"), F.max("branches_covered").alias("branches_covered"))
    fresh = run.stage("fresh", fresh)
    run.write("line_coverage", incremental.replace_reports(run.old("line_coverage"), fresh, ["report_path", "test_suite"]))
    run.finish()
