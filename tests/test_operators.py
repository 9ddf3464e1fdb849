"""Operators on small graphs with known answers."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from graphloom.operators import context, coverage, graph, history, incremental, matching, relations, resolve, search
from graphloom.schema import KEYS, SCHEMAS


@pytest.fixture(scope="module")
def g(spark):
    """foo calls bar, test_foo calls foo; bar is documented."""
    symbols = [(1, 1, "m", "m", "Module", 1, 9), (2, 1, "foo", "m::foo", "Function", 2, 3), (3, 1, "bar", "m::bar", "Function", 4, 5), (4, 2, "test_foo", "t::test_foo", "Function", 1, 2), (5, 2, "dup", "t::dup", "Class", 3, 4), (6, 1, "dup", "m::dup", "Class", 6, 7)]
    edges = [(2, 3, None, "Calls", 1.0, 0), (4, 2, None, "Calls", 1.0, 0), (4, None, "m::bar", "Calls", 0.5, 1), (4, None, "m.foo", "Calls", 0.5, 2), (4, None, "x.bar", "Calls", 0.5, 3), (4, None, "dup", "Calls", 0.5, 4), (4, None, "serde::to", "Calls", 0.5, 5)]
    df = spark.createDataFrame
    return SimpleNamespace(
        files=df([(1, 7, "src/m.py", "python"), (2, 7, "tests/t.py", "python")], "id long, repository_id long, path string, language string"),
        symbols=df(symbols, SCHEMAS["symbols"].replace("id long, file_id long", "id long, file_id long")),
        edges=df(edges, SCHEMAS["edges"]), tests=df([(4, 2, "test_foo", "t::test_foo", "Function")], "id long, file_id long, name string, qualified_name string, kind string"),
        docs=df([(1, 1, 3, "Bar", "registers patients, records medical details"), (2, 1, None, "Other", 'see m::foo and m.bar "patient')], "id long, file_id long, symbol_id long, title string, body string"),
    )


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_traversal(spark, g):
    start = g.symbols.filter("id = 4").select("id")
    nodes = graph.traverse(g.edges, start, depth=2)
    assert ids(nodes, "id", "depth") == [(2, 1), (3, 2), (4, 0)]
    assert ids(graph.reached_edges(g.edges, nodes), "source_symbol_id", "target_symbol_id") == [(2, 3), (4, 2)]
    bar = g.symbols.filter("id = 3").select("id")
    assert ids(graph.impact(g, bar), "id", "direction", "depth") == [(2, "up", 1), (3, "down", 0), (3, "up", 0), (4, "up", 2)]
    assert ids(graph.impact_tests(g, resolve.direct_call_tests(g), bar), "test_id", "linked_id") == [(4, 2)]
    assert ids(graph.impact_docs(g, bar), "doc_id") == [(1,)]


def test_callers(g):
    assert ids(relations.sources_of(g, "bar", "Calls"), "source_qname", "confidence") == [("m::foo", 1.0), ("t::test_foo", 0.5)]
    assert ids(relations.sources_of(g, "m::bar", "Calls"), "source_qname", "confidence") == [("m::foo", 1.0), ("t::test_foo", 0.5)]
    assert relations.targets_of(g, "test_foo", "Calls").count() == 6
    assert ids(relations.start_symbols(g, "m::foo"), "id") == [(2,)] and ids(relations.start_symbols(g, "dup"), "id") == [(5,), (6,)]
    assert ids(relations.fuzzy_find(g, "BA"), "id") == [(3,)]


def test_resolution(g):
    rows = {r.unresolved_target: (r.resolved_id, r.stage) for r in resolve.resolve_edges(g).collect()}
    assert rows == {"m::bar": (3, "exact"), "m.foo": (2, "dotted"), "x.bar": (3, "unique"), "dup": (None, "none"), "serde::to": (None, "none")}
    spark = g.edges.sparkSession
    owners = spark.createDataFrame([(4, 9)], "source_symbol_id long, package_id long")
    deps = spark.createDataFrame([(9, "serde"), (8, "dup")], "package_id long, name string")
    assert ids(resolve.resolve_external(resolve.resolve_edges(g), owners, deps), "external_file") == [("external:serde",)]
    kept = resolve.write_back(g, resolve.resolve_edges(g))
    assert ids(kept, "source_symbol_id", "target_symbol_id", "late") == [(2, 3, 0), (4, 2, 0), (4, 3, 1)]


def test_generated_and_docs(spark, g):
    symbols = spark.createDataFrame([(1, "User"), (2, "UserSerializer"), (3, "Db_Impl"), (4, "Db"), (5, "DaggerApp")], "id long, name string")
    marks = spark.createDataFrame([(1, "Serializable"), (4, "Other")], "symbol_id long, mark string")
    assert ids(resolve.generated_links(symbols, marks), "generated_id", "base_id", "kind") == [(2, 1, "ConfiguredBy")]
    assert ids(resolve.doc_symbol_links(g), "doc_id", "symbol_id") == [(1, 3)]
    assert ids(resolve.doc_body_links(g, g.symbols.filter("kind = 'Function'")), "doc_id", "symbol_id") == [(2, 2), (2, 3)]


def test_cochange(spark):
    items = spark.createDataFrame([(1, "utils"), (2, "utils"), (2, "main")], "commit_id long, item string")
    assert ids(history.cochange(items), "a", "b", "n_together", "rate") == [("main", "utils", 1, 100.0), ("utils", "main", 1, 50.0)]
    commits = spark.createDataFrame([(1, "A", "a@x", "2024-01-02"), (2, "B", "b@x", "2024-01-01")], "id long, author_name string, author_email string, authored_date string")
    top = {r["item"]: r for r in history.git_metadata(items, commits).collect()}
    assert top["utils"].churn == 2 and top["utils"].commit_id == 1 and sorted(top["utils"].authors) == ["A <a@x>", "B <b@x>"]


def test_coverage(spark):
    lines = spark.createDataFrame([(1, "unit", 1, 1), (1, "unit", 2, 0), (1, "it", 1, 0), (1, "it", 2, 3)], "file_id long, suite string, line long, hits long")
    assert ids(coverage.coverage_profile(lines.filter("suite = 'unit'")), "covered", "coverable", "percent") == [(1, 2, 50.0)]
    assert ids(coverage.coverage_profile(lines), "covered", "coverable") == [(2, 2)]
    alone = spark.createDataFrame([(1, "a", 5, 0), (1, "b", 6, 1)], "file_id long, suite string, line long, hits long")
    assert ids(coverage.coverage_profile(alone), "covered", "coverable") == [(2, 2)]  # unknown to the other suite counts as covered
    gaps = spark.createDataFrame([(1, "a", n, 0) for n in (1, 2, 3, 7)], "file_id long, suite string, line long, hits long")
    assert ids(coverage.uncovered_spans(gaps), "first_line", "last_line") == [(1, 3), (7, 7)]
    nested = spark.createDataFrame([(1, "outer", 1, 200), (1, "inner", 60, 70)], "file_id long, symbol string, start_line long, end_line long")
    hit = spark.createDataFrame([(1, "a", 65, 1), (1, "a", 130, 0)], "file_id long, suite string, line long, hits long")
    assert ids(coverage.symbol_coverage(hit, nested), "symbol", "lines_valid", "lines_covered") == [("inner", 1, 1), ("outer", 2, 1)]


def test_safety(spark):
    blocks = spark.createDataFrame([(1, 5, 6), (1, 50, 60)], "f long, start long, end long")
    functions = spark.createDataFrame([(1, 1, 10)], "f long, lo long, hi long")
    ffi = spark.createDataFrame([(1,)], "f long")
    r = coverage.safety_profile(blocks, functions, ffi, "f").collect()[0]
    assert (r.exposed, r.wrapped, r.score, r.risk, r.safe_wrapper_percent) == (1, 1, 68, "Medium", 50.0)


def test_set_metrics(spark):
    rows = spark.createDataFrame([("x", ["a", "b"], ["b", "c"]), ("y", [], []), ("z", [], ["a"])], "k string, retrieved array<string>, expected array<string>")
    got = {r.k: (r.precision, r.recall, r.f1, r.success) for r in matching.set_metrics(rows, ["k"]).collect()}
    assert got == {"x": (0.5, 0.5, 0.5, False), "y": (1.0, 1.0, 1.0, True), "z": (0.0, 0.0, 0.0, False)}


def test_whole_words(spark):
    rows = spark.createDataFrame([("fn run()",), ("fn running()",), ("fn _run()",), ("let prun = 2;",), ("x.run",)], "t string")
    assert [r[0] for r in rows.select(search.has_word(F.col("t"), "run")).collect()] == [True, False, False, False, True]


def test_search(g):
    assert ids(search.search(g.docs, "id", "medical details", "title", "body"), "doc") == [(1,)]
    assert ids(search.search(g.docs, "id", 'edical "', "title", "body"), "doc") == [(1,)]  # no such word: substring
    assert search.sanitise(' a"b%c_d-e:f.g ') == "abc_d-e:f.g"
    spark = g.docs.sparkSession
    rows = spark.createDataFrame([('"""Doc.\n\nMore."""',), ("'one'",), ("  x  ",)], "b string")
    assert [r[0] for r in rows.select(search.excerpt(F.col("b"))).collect()] == ["Doc....", "one", "x"]


def test_search_language(spark):
    docs = spark.createDataFrame([(1, "Big red fox", "runs"), (2, "red big fox", None), (3, "Été", "big redder"), (4, None, "e\u0301te a_b"), (5, "big", "red")], "id long, title string, body string")
    found = lambda q: sorted(r.doc for r in search.bm25(docs, "id", q, "title", "body").collect())
    assert found("big red") == [1, 2, 5] and found('"big red"') == [1]  # a phrase lies in one column
    assert found("red*") == [1, 2, 3, 5] and found('"big red" *') == [1, 3]
    assert found("ete") == found("ÉTÉ") == [3, 4] and found("a_b") == [4]
    assert found("runs OR ete") == [1, 3, 4] and found("big NOT fox") == [3, 5] and found("red AND fox NOT runs OR a_b") == [2, 4]
    assert found("big or red") == []  # operators are upper-case
    for text in ("", "a.b", 'big "', "OR big", "big AND", "big NOT OR red", "* big"):
        assert search.parse(text) is None and found(text) == []
    rows = spark.createDataFrame([("a a a-A b aa",), ("ÀA a",)], "t string").select(search.folded(F.col("t")).alias("t"))
    counts = [search.Phrase(w, o).count(F.col("t")).alias(f"c{k}") for k, (w, o) in enumerate([(("a", "a"), False), (("a", "a"), True), (("a",), False), (("a",), True)])]
    assert [tuple(r) for r in rows.select(*counts).collect()] == [(3, 3, 4, 5), (0, 0, 1, 2)]
    scores = [r.doc for r in search.bm25(docs, "id", "runs OR fox", "title", "body").collect()]
    assert scores == [1, 2]  # both words go before one


def test_paths(spark):
    files = spark.createDataFrame([("a/b/c.rs",), ("a/x.rs",), ("z.rs",)], "path string")
    packages = spark.createDataFrame([("root", "", 0), ("a", "a", 1), ("ab", "a/b", 2), ("ab2", "a/b", 3)], "package string, dir string, position int")
    assert ids(matching.owning_package(files, packages), "path", "package") == [("a/b/c.rs", "ab2"), ("a/x.rs", "a"), ("z.rs", "root")]
    reported = spark.createDataFrame([("b/c.rs",), ("build/z.rs",), ("c",)], "path string")
    assert ids(matching.suffix_match(reported, files), "reported", "known") == [("b/c.rs", "a/b/c.rs"), ("build/z.rs", "z.rs")]


def test_incremental(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", "4")], "path string, content_hash string")
    known = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None), ("d", "5")], "path string, content_hash string")
    assert ids(incremental.diff(found, known), "path", "status") == [("a", "unchanged"), ("b", "changed"), ("c", "changed"), ("d", "deleted"), ("n", "new")]
    writes = spark.createDataFrame([(1, "k", "old", 1), (2, "k", "new", 2), (3, "j", "one", 3)], "id long, key string, v string, seq long")
    assert ids(incremental.upsert(writes, ["key"], "seq"), "id", "key", "v") == [(1, "k", "new"), (3, "j", "one")]
    old = spark.createDataFrame([(None, 1), ("s", 2)], "suite string, n int")
    new = spark.createDataFrame([(None, 9)], "suite string, n int")
    assert sorted(map(str, (tuple(r) for r in incremental.replace_reports(old, new, ["suite"]).collect()))) == sorted(map(str, [("s", 2), (None, 9)]))


def test_deleted_files_leave_names(g):
    left = incremental.delete_files(g.edges, g.symbols, g.files.filter("id = 1").select("id"))
    rows = ids(left.filter("kind = 'Calls'"), "source_symbol_id", "unresolved_target")
    assert (4, "m::foo") in rows and (4, "m::bar") in rows and all(s == 4 for s, _ in rows) and len(rows) == 6


def test_channels_and_steps(spark):
    s = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1)], "scope string, channel int")
    r = spark.createDataFrame([("b", 1), ("c", 2)], "scope string, channel int")
    assert ids(matching.channel_pairs(s, r), "sender", "receiver") == [("a", "b")]
    calls = spark.createDataFrame([("p", k, n) for k, n in enumerate(("a", "a", "map", "b", "a", "c"))], "scope string, ordering int, name string")
    steps = graph.pipeline_steps(calls, "scope", "ordering", "name", F.col("name") == "b")
    assert ids(steps, "step", "name", "mark") == [(0, "a", "before"), (1, "b", "target"), (2, "a", "after"), (3, "c", "after")]


def test_context_pack(spark):
    items = [(0, 50), (1, 30), (1, 40), (1, 1), (2, 10), (3, 5), (3, 5), (4, 2)]
    assert context.fit(items, 100) == [True, True, False, False, True, True, True, False]
    assert context.fit(items, None) == [True] * 8 and context.fit([(0, 9), (3, 5), (3, 6)], 15) == [True, False, False]
    rows = spark.createDataFrame([("t", s, k, f"i{k}", n) for k, (s, n) in enumerate(items)], "target string, section int, position int, item string, tokens int")
    assert context.pack(rows, 100).count() == 5
    text = context.markdown("x", {"Docs": ["one"], "Tests": []})
    assert "- Estimated Tokens: 7" in text and "Tests" not in text


def test_names(spark):
    rows = spark.createDataFrame([("test_a",), ("TestB",), ("b_test",), ("test_",), ("x",)], "name string")
    assert [r[0] for r in rows.select(matching.similarity_target(F.col("name"))).collect()] == ["a", "B", "b", None, None]


def test_schemas(spark):
    for name, ddl in SCHEMAS.items():
        assert set(KEYS[name]) <= set(spark.createDataFrame([], ddl).columns)


def test_stream_of_snapshots(spark, tmp_path):
    from graphloom.streaming.incremental import index_batches

    schema = "path string, content_hash string"
    for k, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "2"), ("c", "1")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = index_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "snap"), str(tmp_path / "out"), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
    assert ids(spark.read.parquet(str(tmp_path / "out")), "batch", "path", "status") == [(0, "a", "new"), (0, "b", "new"), (1, "a", "changed"), (1, "c", "new")]


def test_contained_equals_all_pairs(spark):
    import random

    rng = random.Random(5)
    some = lambda: rng.choice([None, 1, 1, 1, 2])
    blocks = [(some(), s, s + rng.randrange(6), rng.randrange(3)) for s in (rng.randrange(-20, 200) for _ in range(300))] + [(1, None, 3, 0), (1, 5, None, 0)]
    functions = [(some(), lo, lo + rng.randrange(40)) for lo in (rng.randrange(-20, 200) for _ in range(12))] + [(1, None, 500), (1, 0, None)]
    want = sorted(b for b in blocks if None not in b and any(None not in f and f[0] == b[0] and f[1] <= b[1] and f[2] >= b[2] for f in functions))
    b = spark.createDataFrame(blocks, "g long, start long, end long, tag long")
    f = spark.createDataFrame(functions, "g long, lo long, hi long")
    for width in (7, 1024):
        assert sorted(tuple(r) for r in coverage.contained(b, f, "g", width).select("g", "start", "end", "tag").collect()) == want and want
    assert coverage.contained(b, f.limit(0), "g").count() == 0 and coverage.contained(b.limit(0), f, "g").count() == 0
