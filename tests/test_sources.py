"""Adapters on small sources, and readers end to end."""

import subprocess

from graphloom.sources import facts, manifests, markup, python_code, repo, reports, scanners


def have(rows, fact, *fields):
    return [tuple(getattr(f, x) for x in fields) for f in rows if f.fact == fact]


PYTHON = '''"""Module doc."""
from .base import Thing
import os.path as p
from functools import partial
from pydantic import BaseModel, field_validator

class User(BaseModel):
    name: str
    age: int = ...
    nick: Thing = None

    @field_validator("name")
    def check(cls, v):
        return v

class TestA:
    def run(self):
        """Runs."""
        self.other()
        self.run()
        helper(1)
        p.join("a")
        add3 = partial(add, 1)
        return list(map(helper, [1]))

@app.get("/users/{id}", response_model=User)
async def show(id: int) -> User:
    def inner():
        pass
    return inner

@app.route("/x", methods=["POST", "PUT"])
def many(): ...

@pytest.fixture
def db(): ...

@pytest.mark.parametrize("x", [1])
def test_many(x): ...

def helper(x): ...
def add(a, b, c): ...
'''


def test_python():
    rows = list(python_code.extract("src/m.py", PYTHON))
    assert ("src.m::TestA.run", "Method") in have(rows, "symbol", "qualified_name", "kind") and ("src.m::show.inner", "Function") in have(rows, "symbol", "qualified_name", "kind")
    assert have(rows, "import", "target")[:2] == [("src.base.Thing",), ("os.path",)]
    calls = {f.target: f.detail["confidence"] for f in rows if f.fact == "call"}
    assert calls["src.m::TestA.run"] == "1.0" and calls["TestA.other"] == "0.8" and calls["src.m::helper"] == "1.0" and calls["p.join"] == "0.5" and calls["list"] == "0.7"
    assert [f.detail["placeholders"] for f in rows if f.fact == "call" and "placeholders" in f.detail] == ["b, c"]
    assert sorted(have(rows, "route", "kind", "target")) == [("GET", "/users/{id}"), ("POST", "/x"), ("PUT", "/x")]
    assert [(n, d["required"]) for n, d in have(rows, "field", "name", "detail")] == [("name", "true"), ("age", "true"), ("nick", "false")]
    assert have(rows, "validator", "name", "kind", "target") == [("check", "field", "name")]
    assert sorted(have(rows, "test", "name", "kind")) == [("TestA", "Class"), ("db", "Fixture"), ("test_many", "Function")]
    assert ("Runs.",) in have(rows, "doc", "target") and ("Thing",) in have(rows, "type", "target")


def test_rust():
    text = 'use std::sync::mpsc;\nmod inner {\n  pub struct S { a: i32 }\n}\nimpl Show for S {\n  fn show(&self) -> i32 { help(1) }\n}\n#[test]\nfn works() {\n  let (tx, rx) = mpsc::channel();\n  thread::spawn(|| {});\n  unsafe { go() }\n}\nunsafe fn raw() {}\nextern "C" { fn puts(); }\nfn help(x: i32) -> i32 { x } // fn not_this() {}\n#[get("/a")]\nfn page() {}\n'
    rows = list(scanners.extract("rust", "src/lib.rs", text))
    names = dict(have(rows, "symbol", "name", "kind"))
    assert names["S"] == "Struct" and names["show"] == "Method" and names["help"] == "Function" and "not_this" not in names
    assert have(rows, "test", "name") == [("works",)] and have(rows, "channel", "name", "target", "kind") == [("tx", "rx", "mpsc")]
    assert have(rows, "spawn", "name") == [("thread::spawn",)] and {x for x, in have(rows, "unsafe", "kind")} == {"block", "function"} and have(rows, "ffi", "name") == [("C",)]
    assert have(rows, "route", "kind", "target", "name") == [("GET", "/a", "page")] and have(rows, "base", "target") == [("Show",)] and have(rows, "import", "target") == [("std::sync::mpsc",)]
    assert ("src::lib::help", "1.0") in [(t, d["confidence"]) for t, d in have(rows, "call", "target", "detail")]


def test_kotlin_swift_fsharp_mojo():
    k = list(scanners.extract("kotlin", "App.kt", 'import a.b.C\nclass App : Base(), Other {\n  val x = 1\n  fun run() {\n    val y = 2\n    scope.launch { go() }\n  }\n}\nenum class E { A }\nfun routes() {\n  route("/api") {\n    get("/u") { call() }\n  }\n}\n'))
    assert dict(have(k, "symbol", "name", "kind")) == {"App": "Class", "x": "Unknown", "run": "Method", "E": "Enum", "routes": "Function"}
    assert have(k, "route", "kind", "target") == [("GET", "/api/u")] and [b for b, in have(k, "base", "target")] == ["Base", "Other"] and have(k, "spawn", "name") == [("scope.launch",)]
    s = list(scanners.extract("swift", "A.swift", "import UIKit\nclass T: XCTestCase {\n  func testIt() { helper() }\n}\nprotocol P {}\n@Test(arguments: [1])\nfunc many() {}\n"))
    assert sorted(have(s, "test", "name")) == [("many",), ("testIt",)] and dict(have(s, "symbol", "name", "kind"))["P"] == "Interface"
    f = list(scanners.extract("fsharp", "L.fs", "module Lib.Core\nopen System\n\ntype User =\n  member this.Name = 1\n\n[<Fact>]\nlet works () =\n  helper (1)\n"))
    assert have(f, "test", "name") == [("works",)] and ("System",) in have(f, "import", "target") and ("Name", "Method") in have(f, "symbol", "name", "kind")
    m = list(scanners.extract("mojo", "m.mojo", "from a.b import c\nstruct S:\n    fn go(self):\n        run()\n\nfn test_x():\n    run()\n"))
    assert dict(have(m, "symbol", "name", "kind"))["go"] == "Method" and have(m, "test", "name") == [("test_x",)] and have(m, "import", "target") == [("a.b",)]


def test_qualified_names_by_language():
    first = lambda language, path, text: have(list(scanners.extract(language, path, text)), "symbol", "qualified_name")
    assert first("rust", "src/a/mod.rs", "fn f() {}\n") == [("src::a",), ("src::a::f",)]
    assert first("kotlin", "x/App.kt", "package com.example\nclass App {\n  fun run() {}\n}\n")[1:] == [("com.example::App",), ("com.example::App.run",)]
    assert first("swift", "Sources/App.swift", "class App {\n  func run() {}\n}\n") == [("Sources.App",), ("Sources.App::App",), ("Sources.App::App.run",)]
    assert first("fsharp", "L.fs", "module Lib.Core\n\nlet run () = 1\n") == [("Lib.Core",), ("Lib.Core.run",)]
    assert first("mojo", "main.mojo", "fn run():\n    pass\n") == [("main",), ("main::run",)]


def test_markup():
    assert markup.sections("lead\n# A\nbody\n#no\n## B ##\n") == [(None, "lead", 1, 1), ("A", "body\n#no", 2, 4), ("B", "", 5, 6)]
    book = '{"cells": [{"cell_type": "code", "source": ["%magic\\n", "def f(): pass\\n"]}, {"cell_type": "markdown", "source": "# T\\nx"}, {"cell_type": "code", "source": "g()"}]}'
    rows = list(markup.notebook("n.ipynb", book))
    assert ("f",) in have(rows, "symbol", "name") and ("T", "x") in have(rows, "doc", "name", "target")


def test_manifests():
    rows = list(manifests.cargo("Cargo.toml", '[package]\nname = "a"\nversion = "1.2"\n[dependencies]\nserde = { version = "1", features = ["derive"] }\nlog.workspace = true\n[dev-dependencies]\nx = "2"\n[workspace]\nmembers = ["m"]\n'))
    assert have(rows, "dependency", "name", "kind", "target") == [("serde", "", "1"), ("log", "", None), ("x", "dev", "2")] and ("a", "1.2") in have(rows, "package", "name", "target")
    assert have(manifests.fsproj("p/Lib.fsproj", '<Project><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup><ItemGroup><PackageReference Include="X" Version="1"/></ItemGroup></Project>'), "dependency", "name", "target") == [("X", "1")]
    assert manifests.solution('Project("{A}") = "L", "src\\L.fsproj", "{B}"') == ["src/L.fsproj"] and manifests.paket("nuget A ~> 1\nnuget B\n") == {"A": "~> 1", "B": ""}
    assert have(manifests.gradle("app/build.gradle.kts", 'implementation("a.b:c:1.0")\napi(project(":core"))'), "dependency", "name", "kind", "target") == [("a.b:c", "implementation", "1.0"), (":core", "project", None)]
    assert have(manifests.pom("pom.xml", '<project xmlns="x"><artifactId>p</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>3</version></dependency></dependencies></project>'), "dependency", "name", "target") == [("g:a", "3")]
    assert have(manifests.swift_package("Package.swift", '// swift-tools-version: 5.9\nlet p = Package(name: "P", dependencies: [.package(url: "https://h/o/R.git", from: "1.0.0"), .package(path: "../L")])'), "dependency", "name", "target") == [("R", "1.0.0"), ("L", None)]
    ns = 'xmlns:android="http://schemas.android.com/apk/res/android"'
    layout = list(manifests.android("res/layout-land/main.xml", f'<L {ns}><com.x.View android:id="@+id/v" android:text="@string/hi"/></L>'))
    assert ("R.layout.main",) in have(layout, "resource", "qualified_name") and ("R.string.hi",) in have(layout, "link", "target") and ("com.x.View",) in have(layout, "link", "target")
    assert have(manifests.android("x/AndroidManifest.xml", f'<manifest {ns}><uses-permission android:name="P"/><application android:name=".A"><activity android:name=".M"/></application></manifest>'), "resource", "name", "kind") == [("P", "permission"), (".A", "application"), (".M", "activity")]


def test_reports(spark):
    lcov = "TN:unit\nSF:a.py\nDA:1,1\nDA:2,0\nDA:2,3\nBRDA:2,0,0,-\nBRDA:2,0,1,4\nend_of_record\n"
    assert list(reports.lcov(lcov)) == [("unit", "a.py", 1, 1, 0, 0), ("unit", "a.py", 2, 3, 2, 1)]
    xml = '<coverage><class filename="b.py"><lines><line number="3" hits="0"/><line number="4" hits="2" branch="true" condition-coverage="50% (1/2)"/></lines></class></coverage>'
    assert list(reports.cobertura(xml)) == [(None, "b.py", 3, 0, 0, 0), (None, "b.py", 4, 2, 2, 1)]
    df = spark.createDataFrame([("l", lcov), ("x", xml)], "path string, content string")
    assert reports.read(df, "all").filter("suite = 'all'").count() == 4


def test_repository_end_to_end(spark, tmp_path):
    root = tmp_path / "r"
    (root / "src").mkdir(parents=True)
    (root / "build").mkdir()
    (root / "src/a.py").write_text("from b import go\n\ndef main():\n    go()\n")
    (root / "src/broken.py").write_text("def (:\n")
    (root / "src/bad.py").write_bytes(b"\xff\xfe\x00")
    (root / "build/c.py").write_text("x = 1\n")
    (root / "README.md").write_text("# Title\ntext\n")
    (root / ".github").mkdir()
    (root / ".github/x.yml").write_text("a: 1\n")
    (root / "src/__init__.py").write_text("VALUE = 1\n")
    (root / "src/empty.py").write_text("")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=A", "-c", "user.email=a@x", "-C", str(root), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "src/a.py")
    git("commit", "-qm", "one | two")
    assert repo.repo_root(root / "src") == root.resolve()
    files = repo.discover(spark, str(root), ["build/", "*.tmp"])
    assert sorted(r.path for r in files.select("path").collect()) == [".github/x.yml", "README.md", "src/__init__.py", "src/a.py", "src/bad.py", "src/broken.py", "src/empty.py"]
    assert [tuple(r) for r in files.filter("path = 'src/empty.py'").select("line_count", "language").collect()] == [(0, "python")]
    rows = facts.extract(files)
    assert sorted(r.path for r in rows.filter("fact = 'diagnostic'").collect()) == ["src/bad.py", "src/broken.py"]
    assert {(r.source, r.unresolved_target, r.kind) for r in facts.edges_of(rows).collect()} == {("src.a", "b.go", "Imports"), ("src.a::main", "go", "Calls")}
    assert facts.symbols_of(rows).filter("kind = 'Function'").count() == 1 and rows.filter("kind = 'Markdown'").count() == 1
    commits, changed = repo.git_history(spark, str(root))
    assert [(r.message, r.author_email) for r in commits.collect()] == [("one | two", "a@x")] and [r["item"] for r in changed.collect()] == ["src/a.py"]
    patch = "@@ -1,3 +1,3 @@\n a\n-b\n+c\n d\n@@ -9 +9,2 @@\n e\n+f\n"
    assert repo.changed_lines(patch) == [2, 10] and repo.changed_symbols(patch, [("m", 1, 3), ("n", 4, 9)]) == ["m"]


LINEAGE = '''
def train(x: torch.Tensor[batch, 3, 224, 224], n: int):
    # shape: (batch, channels, height, width)
    y = conv(x)

    batch, channels, height, width = y.shape
    w: Parameter["a, b"] = new()  # Tensor[c]
    df = df.with_columns(total=pl.col("revenue") * pl.col("rate"))
    df = df.select(pl.col("revenue").alias("rev"), "city", ["age", "not one"])
    df = df.rename({"revenue": "rev", 1: "no"}).filter(col("country") == "US")
    df["rev"] = df["revenue"]
    table["rev"] = other["revenue"]

class A:
    v = z.shape
# shape: ()
'''


def test_python_lineage():
    got = {(f.qualified_name, f.target) for f in python_code.extract("src/model.py", LINEAGE) if f.fact == "type" and "::" in f.target}
    train = {t for q, t in got if q == "src.model::train"}
    shapes = {"[batch, 3, 224, 224]": "x", "[batch, channels, height, width]": "y", "[a, b]": "w", "[c]": "w"}
    assert {t for t in train if t.startswith("shape")} == {f"shape::{s}" for s in shapes} | {f"shape::{n}::{s}" for s, n in shapes.items()}
    assert {t for t in train if " <- " in t} == {
        "col::total <- with_columns(col::rate, col::revenue)", "col::rev <- select(col::revenue)", "col::rev <- rename(col::revenue)", "col::rev <- assign(col::revenue)",
    }
    assert {t for t in train if t.startswith("col") and " <- " not in t} == {f"col::{c}" for c in ("total", "rate", "revenue", "rev", "city", "age", "country")}
    assert {t for q, t in got if q != "src.model::train"} == {"shape::z::[v]", "shape::[v]"}
