"""A repository from files to answers: index, change, index again, ask."""

import subprocess

import pytest

from graphloom.engine import Engine
from graphloom.indexing import import_coverage, index
from graphloom.sources.store import FactStore, StoredGraph

RUST = """use serde::Serialize;
pub fn help(a: i32) -> i32 { a }
pub unsafe fn raw() {
  unsafe { help(1); }
}
pub fn flow() {
  first(); second();
}
fn first() {}
fn second() {}
#[test]
fn works() {
  help(1);
  serde::to_string(1);
}
"""


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("indexing")
    root = base / "r"
    (root / "src").mkdir(parents=True)
    (root / "src/lib.rs").write_text(RUST)
    (root / "Cargo.toml").write_text('[package]\nname = "demo"\nversion = "0.1"\n[dependencies]\nserde = { version = "1", features = ["derive"] }\n')
    (root / "a.py").write_text('from b import go\n\ndef main():\n    """Start."""\n    go()\n')
    (root / "b.py").write_text("def go():\n    return 1\n\ndef test_go():\n    go()\n")
    (root / "README.md").write_text("# go\nText about go.\n")
    (root / "broken.py").write_text("def (:\n")
    (root / "empty.py").write_text("")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=A", "-c", "user.email=a@x", "-C", str(root), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    (root / "b.py").write_text("def go():\n    return 2\n\ndef test_go():\n    go()\n")
    git("commit", "-qam", "two")
    store = FactStore(spark, str(base / "store"))
    assert store.latest() is None and store.row_counts().agg({"n_rows": "sum"}).first()[0] == 0
    summary = {r.status: r.n_files for r in index(spark, str(root), store, history=True).collect()}
    assert summary == {"new": 7}
    return root, store


def have(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def edges(g):
    s = g.symbols
    rows = g.edges.join(s.selectExpr("id source_symbol_id", "qualified_name s"), "source_symbol_id").join(s.selectExpr("id target_symbol_id", "qualified_name t"), "target_symbol_id", "left")
    return {(r.s, r.kind, r.t or r.unresolved_target) for r in rows.collect()}


def test_first_run(indexed):
    _, store = indexed
    g = StoredGraph(store)
    found = edges(g)
    assert {("a::main", "Calls", "b::go"), ("a", "Imports", "b::go"), ("b::test_go", "TestedBy", "b::go"), ("src::lib::works", "TestedBy", "src::lib::help")} <= found
    assert ("src::lib::works", "Calls", "serde::to_string") in found and ("external:serde",) in have(g.files, "path")
    assert have(g.facts.filter("fact = 'diagnostic'"), "path") == [("broken.py",)]
    assert have(g.docs.join(g.symbols.selectExpr("id symbol_id", "qualified_name"), "symbol_id"), "path", "qualified_name") == [("README.md", "b::go"), ("a.py", "a::main")]
    second = g.commits.filter("message = 'two'").selectExpr("id commit_id")
    assert have(g.commit_symbols.join(second, "commit_id"), "item") == [("b",), ("b::go",)]
    assert g.index_runs.first().status == "completed"


def test_engine(indexed, spark, tmp_path):
    _, store = indexed
    e = Engine(StoredGraph(store))
    assert have(e.callers("go"), "source_qname") == [("a::main",), ("b::test_go",)]
    shown = e.show("b::go").first()
    assert shown.source == "def go():\n    return 2" and shown.path == "b.py"
    assert e.show("no::such").count() == 0 and e.show("serde::to_string").first().source is None
    assert have(e.pipeline("first"), "step", "name", "mark") == [(0, "first", "target"), (1, "second", "after")]
    assert have(e.safety("src/lib.rs"), "blocks", "exposed", "score", "risk") == [(1, 1, 85, "Medium")]
    assert have(e.deps("demo"), "name", "version_requirement", "features") == [("serde", "1", ["derive"])] and have(e.workspace(), "name", "version") == [("demo", "0.1")]
    assert {r.section for r in e.pack("b::go").collect()} == set(range(6))
    assert have(e.pack("b::go").filter("section in (1, 2, 5)"), "section", "item") == [(1, "go: Text about go."), (2, "b::test_go"), (5, "main: Start.")]
    assert have(e.pack("b::go", 1), "section") == [(0,)]
    assert {(r.direction, r.depth) for r in e.impact("b::go").collect()} >= {("up", 1)}
    together = {r.b: r.n_together for r in e.cochange("go").collect()}
    assert together["b"] == 2 and together["a::main"] == 1 and "b::go" not in together
    assert {r.b for r in e.cochange("b.py").collect()} == {"Cargo.toml", "README.md", "a.py", "broken.py", "empty.py", "src/lib.rs"}
    assert e.git("b.py").count() == 1
    report = tmp_path / "x.info"
    report.write_text("TN:unit\nSF:/build/b.py\nDA:1,1\nDA:2,0\nDA:4,1\nend_of_record\nTN:unit\nSF:unknown.py\nDA:1,1\nend_of_record\n")
    import_coverage(spark, str(report), store)
    import_coverage(spark, str(report), store)  # the same rows again
    e = Engine(StoredGraph(store))
    assert have(e.coverage("b.py"), "coverable", "covered") == [(3, 2)] and have(e.coverage("b::go"), "lines_valid", "lines_covered") == [(2, 1)]
    assert have(e.uncovered("b.py"), "first_line", "last_line") == [(2, 2)]


def test_second_run(indexed, spark):
    root, store = indexed
    before = {r.qualified_name: r.id for r in StoredGraph(store).symbols.collect()}
    (root / "b.py").write_text("def gone():\n    return 1\n")
    (root / "README.md").unlink()
    summary = {r.status: r.n_files for r in index(spark, str(root), store).collect()}
    assert summary == {"changed": 1, "deleted": 1, "unchanged": 5}
    g = StoredGraph(store)
    after = {r.qualified_name: r.id for r in g.symbols.collect()}
    assert all(before[q] == after[q] for q in before.keys() & after.keys()) and "b::go" not in after and "b::gone" in after
    assert {("a::main", "Calls", "go"), ("a", "Imports", "b.go")} <= edges(g)  # names again
    assert g.commits.count() == 2  # carried over
    store.vacuum()
    assert Engine(StoredGraph(store)).status().filter("table_name = 'files'").first().n_rows == 7
    index(spark, str(root), store, force=True)
    assert edges(StoredGraph(store)) == edges(g)
    store.reset()
    assert store.latest() is None


def test_a_run_that_fails_is_not_seen(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"))
    run = store.begin()
    run.write("files", spark.createDataFrame([(1, "p")], "id long, path string"))
    assert store.latest() is None and store.table("files").count() == 0
    later = store.begin()
    assert later.number == run.number + 1
    later.finish()
    assert store.latest() == later.number


def test_empty_folder(spark, tmp_path):
    (tmp_path / "r").mkdir()
    store = FactStore(spark, str(tmp_path / "s"))
    assert index(spark, str(tmp_path / "r"), store).count() == 0 and StoredGraph(store).symbols.count() == 0
