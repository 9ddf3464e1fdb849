"""Lookups by the reference's rules on small hand-made graphs, and counts that stand for pairs."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import context, history, matching, relations, resolve
from graphloom.plans.catalogue import View


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame([(1, 1, "res/a.xml", "xml"), (2, 1, "src/a.kt", "kotlin"), (3, 1, "src/b.kt", None)], "id long, repository_id long, path string, language string")
    symbols = spark.createDataFrame(
        [(10, 1, "Main", "app::Main", "Class", 1), (20, 2, "Main", "app::Main", "Class", 3), (30, 3, "odd\\name", "app::odd\\name", "Function", 5), (40, 3, "a_b", "app::a_b", "Function", 1), (50, 3, "axb", "app::axb", "Function", 2)],
        "id long, file_id long, name string, qualified_name string, kind string, start_line long",
    )
    tests = spark.createDataFrame([(30, 3, "odd\\name", "app::odd\\name", "Function")], "id long, file_id long, name string, qualified_name string, kind string")
    return View(files=files, symbols=symbols, tests=tests, docs=spark.createDataFrame([(1, "see app.Main or not"), (2, "see app::axb"), (3, None)], "id long, body string"))


def test_symbols_of_other_files_before_xml(graph):
    assert [r.id for r in relations.start_symbols(graph, "app::Main").collect()] == [20]
    assert {r.qualified_name: r.id for r in relations.symbol_by_qualified_name(graph).collect()}["app::Main"] == 20
    assert sorted(r.id for r in relations.start_symbols(graph, "Main").collect()) == [10, 20]


def test_patterns_are_taken_literally(graph):
    ids = lambda name: sorted(r.id for r in relations.fuzzy_find(graph, name).collect())
    assert ids("d\\n") == [30] and ids("A_B") == [40] and ids("%") == [] and ids("x") == [50]


def test_lookups(graph):
    assert [r.id for r in relations.symbols_of_file(graph, "src/b.kt").collect()] == [40, 50, 30]
    assert [r.id for r in relations.tests_of_file(graph, "src/b.kt").collect()] == [30]
    assert relations.file_by_path(graph, "none").count() == 0 and relations.symbol_by_id(graph, 20).first().name == "Main"


def test_names_in_bodies(graph):
    want = {(1, 10), (1, 20), (2, 50)}
    for size in (1, 1 << 20):
        assert {(r.doc_id, r.symbol_id) for r in resolve.doc_body_links(graph, block_chars=size).collect()} == want


def test_counts_equal_pairs(spark):
    sends = spark.createDataFrame([(k % 7, k % 3) for k in range(40)], "scope long, channel long")
    receives = spark.createDataFrame([(k % 5, k % 4) for k in range(40)] + [(None, 1)], "scope long, channel long")
    pairs = matching.channel_pairs(sends, receives).groupBy("channel").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("sender").alias("sum_senders"), F.sum("receiver").alias("sum_receivers"))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, matching.channel_counts(sends, receives).collect()))


def test_cochange_of_one_equals_that_of_all(spark):
    items = spark.createDataFrame([(k // 3, (k * 7) % 11) for k in range(90)], "commit_id long, item long").distinct()
    every = {(r.a, r.b, r.n_together, r.rate) for r in history.cochange(items).collect()}
    assert {x for x in every if x[0] == 4} == {(r.a, r.b, r.n_together, r.rate) for r in history.cochange_of(items, 4).collect()}
    assert {(b, a) for a, b, _, _ in every} == {(a, b) for a, b, _, _ in every}


def test_metrics_of_rows_equal_those_of_sets(spark):
    rows = spark.createDataFrame([("a", 1, True, True), ("a", 2, True, False), ("a", 2, True, None), ("a", 3, False, True), ("b", 1, False, False), ("c", 1, False, True), ("d", 1, True, False)], "k string, item long, retrieved boolean, expected boolean")
    sets = rows.groupBy("k").agg(F.collect_list(F.when(F.col("retrieved"), F.col("item"))).alias("retrieved"), F.collect_list(F.when(F.col("expected"), F.col("item"))).alias("expected"))
    assert sorted(map(tuple, matching.set_metrics(sets, ["k"]).collect())) == sorted(map(tuple, matching.metrics_of_rows(rows, ["k"]).collect()))


def test_packs_as_markdown(spark):
    packed = spark.createDataFrame([("t", 0, 0, "t", 1), ("t", 3, 2, "b", 1), ("t", 3, 1, "a", 1)], "target string, section int, position int, item string, tokens long")
    text = context.rendered(packed).first().text
    assert text == context.markdown("t", {"target": ["t"], "edges": ["a", "b"]})


def test_ignore_files(spark, tmp_path):
    import subprocess

    from graphloom.sources import repo

    tree = {
        ".gitignore": "build/\n*.log\n!keep.log\n/top.txt\ndocs/**/draft.md\n# note\n\\#odd\ndata[0-9].csv\n", "a/.gitignore": "!b.log\nlocal\n",
        "build/x.py": "1", "a/build/y.py": "1", "c.log": "1", "keep.log": "1", "a/b.log": "1", "a/c.log": "1", "top.txt": "1", "a/top.txt": "1", "docs/x/y/draft.md": "1", "docs/draft.md": "1",
        "docs/final.md": "1", "#odd": "1", "data1.csv": "1", "dataA.csv": "1", "a/local/z.py": "1", "local/z.py": "1", "build2/x.py": "1", "a/build/keep.log": "1", "x/build": "1",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    want = subprocess.run(["git", "-C", str(tmp_path), "ls-files", "-o", "--exclude-standard"], capture_output=True, text=True, check=True).stdout.split("\n")
    got = [r.path for r in repo.discover(spark, str(tmp_path)).select("path").collect()]
    assert sorted(got) == sorted(x.strip('"') for x in want if x)


def test_workspace_and_shared_lists(spark, tmp_path):
    from graphloom.indexing import import_coverage, index
    from graphloom.sources.store import FactStore, StoredGraph

    tree = {
        "Cargo.toml": '[workspace]\nmembers = ["a"]\n[workspace.dependencies]\nlog = { version = "0.4", features = ["std"] }\nserde = "1"\n',
        "a/Cargo.toml": '[package]\nname = "a"\nversion = "0.1.0"\n[dependencies]\nlog = { workspace = true, features = ["kv"] }\nserde = { workspace = true }\nown = "2"\n',
        "Cargo.lock": '[[package]]\nname = "serde"\nversion = "1.0.9"\n',
        "paket.dependencies": "nuget FSharp.Core >= 8\nnuget Other 1.2\n", "p/paket.references": "FSharp.Core\n", "p/P.fsproj": "<Project></Project>",
        "a/src/lib.rs": "pub fn send_all(tx: Sender) {\n    tx.send(1);\n}\n\nfn take(rx: Receiver) {\n    rx.recv();\n}\n\nfn start() {\n    let (tx, rx) = mpsc::channel();\n}\n",
        "m.py": "class M(BaseModel):\n    a: int\n\n    @field_validator('a', 'b')\n    def check(cls, v):\n        return v\n",
        "test_m.py": "def test_check(tool):\n    pass\n",
    }
    for name, text in tree.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    store = FactStore(spark, str(tmp_path / "s"))
    index(spark, str(tmp_path / "r"), store)
    g = StoredGraph(store)
    names = {r.id: r.name for r in g.packages.collect()}
    got = {(names[r.package_id], r.name): (r.version_requirement, r.is_workspace_dependency, r.features) for r in g.dependencies.collect()}
    assert got == {("a", "log"): ("0.4", True, ["kv", "std"]), ("a", "serde"): ("1.0.9", True, []), ("a", "own"): ("2", False, []), ("P", "FSharp.Core"): (">= 8", False, [])}
    symbols = {r.id: r.qualified_name for r in g.symbols.collect()}
    edges = {(symbols[r.source_symbol_id], symbols.get(r.target_symbol_id, r.unresolved_target), r.kind) for r in g.edges.collect()}
    assert ("a::src::lib::send_all", "a::src::lib::take", "SendsTo") in edges and ("test_m::test_check", "m::M.check", "TestedBy") in edges and ("test_m::test_check", "tool", "ConfiguredBy") in edges
    assert [(r.name, r.kind, r.fields) for r in g.table("model_validators").collect()] == [("check", "field", ["a", "b"])]
    (tmp_path / "lcov.info").write_text("TN:unit\nSF:m.py\nDA:1,1\nBRDA:1,0,0,1\nBRDA:1,0,1,-\nDA:2,0\nend_of_record\n")
    import_coverage(spark, str(tmp_path / "lcov.info"), store)
    assert [(r.line, r.hits, r.branches_valid, r.branches_covered) for r in StoredGraph(store).coverage.orderBy("line").collect()] == [(1, 1, 2, 1), (2, 0, 0, 0)]


def test_failed_run_leaves_a_row(spark, tmp_path, monkeypatch):
    from graphloom import indexing
    from graphloom.sources.store import FactStore, StoredGraph

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("x = 1\n")
    store = FactStore(spark, str(tmp_path / "s"))
    indexing.index(spark, str(tmp_path / "r"), store)
    monkeypatch.setattr(indexing, "_details", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        indexing.index(spark, str(tmp_path / "r"), store)
    runs = store.table("index_runs").orderBy("id").collect()
    assert [r.status for r in runs] == ["completed", "failed"] and "ZeroDivisionError" in runs[1].error_message
    assert [r.path for r in StoredGraph(store).files.collect()] == ["a.py"]


def test_search_by_words_of_any_script(spark):
    from graphloom.operators import search

    docs = spark.createDataFrame([(1, "Über den Fluss", ""), (2, "uber", ""), (3, "a.b c", "")], "id long, title string, body string")
    ids = lambda q: [r.doc for r in search.search(docs, "id", q, "title", "body").collect()]
    assert ids("über fluss") == [1] and ids("a.b") == [3] and ids("luss") == [1]
