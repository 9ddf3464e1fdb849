"""Source files, manifests and reports written from the tables, so that every adapter has a query over whole tables.

A file is a template with ``{k}`` (a customer's number) and ``{n}`` (its nation's); it is filled in by Spark, one file a customer.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import resolve
from graphloom.shared import cut, spread
from graphloom.sources import facts, report_lines, reports


class View:
    """Tables under the names that the operators expect."""

    def __init__(self, **tables: DataFrame):
        self.__dict__.update(tables)


#: Path and text of a file of each language.
FILES = {
    "python": ("src/c{k}.py", '''import nation_{n}
from shop.area import Zone as Area


class Order{k}(Base{n}):
    """Order of {k}."""

    @cached
    def total(self, item: Item{n}) -> Area:
        self.check()
        helper(1)
        shop.send(item)

    def check(self):
        return None


class Form{k}(BaseModel):
    amount: int = 3
    area: Area

    @field_validator("area")
    def known(cls, v):
        return v


class Net{k}(nn.Module):
    def __init__(self):
        self.layer = Layer{n}(4)


@app.get("/orders/{k}")
def helper(n: int):
    return n


def test_helper(total):
    helper(2)
'''),
    "lineage": ("etl/c{k}.py", '''def load(x: Tensor[batch, {n}]):
    # shape: (batch, area{n})
    y = x
    rows, cols = y.shape
    df = df.select(col("sum{n}").alias("sum"))
    df["key{k}"] = df["sum"]
    return df.rename({"sum": "total{n}"})
'''),
    "rust": ("crates/c{k}/src/lib.rs", '''use shop::area{n}::Zone;

pub struct Order{k} { zone: Zone, rest: Vec<Item{n}> }

impl Check for Order{k} {
    fn total(&self, item: Item{n}) -> Zone {
        self.check();
        helper(1)
    }
    fn check(&self) {}
}

fn helper(n: i32) -> Zone {
    unsafe { shop::raw(n) }
}

#[cfg(feature = "extra")]
fn hidden() {
    helper(9);
}

fn start() {
    let (tx, rx) = mpsc::channel();
    std::thread::spawn(move || consume(rx));
    produce(tx);
}

fn produce(tx: Sender<i32>) {
    tx.send({k});
}

fn consume(rx: Receiver<i32>) {
    rx.recv();
}

#[test]
fn test_helper() {
    helper(2);
}
'''),
    "kotlin": ("app/c{k}.kt", '''package shop.c{k}

import shop.area{n}.Zone

interface Check

class Order{k}(val zone: Zone) : Base{n}(zone), Check {
    @Cached
    fun total(item: Item{n}): Zone {
        check()
        Zone.of(item)
        return helper(1)
    }
    fun check() {}
}

fun helper(n: Int): Zone {
    return other.make(n)
}
'''),
    "swift": ("Sources/c{k}.swift", '''import Area{n}

protocol Check {}

@objc class Order{k}: Base{n}, Check {
    func total(item: Item{n}) -> Zone {
        self.check()
        return helper(1)
    }
    func check() {}
}

func helper(n: Int) -> Zone {
    return other.make(n)
}
'''),
    "fsharp": ("src/C{k}.fs", '''module Shop.C{k}

open Shop.Area{n}

let helper (n: Item{n}) =
    make(n)

let total x =
    helper(x)
'''),
    "mojo": ("src/c{k}.mojo", '''from shop.area{n} import Zone

struct Order{k}:
    fn total(self, item: Item{n}) -> Zone:
        self.check()
        return helper(1)

    fn check(self):
        pass

fn helper(n: Int) -> Zone:
    return make(n)

fn test_helper():
    helper(2)
'''),
    "cargo": ("crates/c{k}/Cargo.toml", '''[package]
name = "c{k}"
version = "0.{n}.0"

[dependencies]
serde = { version = "1.{n}", features = ["derive"] }
log = { workspace = true }

[dev-dependencies]
proptest = "1"

[build-dependencies]
cc = "1.{n}"

[target.'cfg(unix)'.dependencies]
nix = "0.2"
'''),
    "fsproj": ("src/C{k}.fsproj", '''<Project Sdk="Microsoft.NET.Sdk">
  <PropertyGroup><TargetFramework>net8.{n}</TargetFramework></PropertyGroup>
  <ItemGroup>
    <PackageReference Include="FSharp.Core" Version="8.{n}" />
    <ProjectReference Include="../lib/L{k}.fsproj" />
  </ItemGroup>
</Project>
'''),
    "paket": ("p{k}/paket.dependencies", '''source https://example.org/feed
nuget FSharp.Core >= {n}
nuget Area{k}
'''),
    "gradle": ("app{k}/build.gradle.kts", '''plugins { kotlin("jvm") }
dependencies {
    implementation("org.example:area:{n}.1")
    testImplementation("junit:junit:4.{n}")
    implementation(project(":lib{k}"))
}
'''),
    "maven": ("m{k}/pom.xml", '''<project xmlns="http://maven.apache.org/POM/4.0.0">
  <artifactId>c{k}</artifactId><version>1.{n}</version>
  <dependencies><dependency><groupId>org.example</groupId><artifactId>area</artifactId><version>{n}</version><scope>test</scope></dependency></dependencies>
</project>
'''),
    "swiftpm": ("s{k}/Package.swift", '''// swift-tools-version:5.{n}
let package = Package(
    name: "C{k}",
    dependencies: [.package(url: "https://example.org/area{n}.git", from: "1.{n}.0")]
)
'''),
    "android": ("app{k}/src/main/AndroidManifest.xml", '''<manifest xmlns:android="http://schemas.android.com/apk/res/android">
  <uses-permission android:name="perm.P{n}" />
  <application><activity android:name=".Main{k}"><intent-filter><action android:name="act.A{n}" /></intent-filter></activity></application>
</manifest>
'''),
    "values": ("app{k}/src/main/res/values/strings.xml", '''<resources>
  <string name="title_{k}">Title {n}</string>
  <color name="tint">#{n}</color>
</resources>
'''),
    "layout": ("app{k}/src/main/res/layout/main_{k}.xml", '''<LinearLayout xmlns:android="http://schemas.android.com/apk/res/android">
  <TextView android:id="@+id/label_{n}" android:text="@string/title_{k}" />
</LinearLayout>
'''),
    "notebook": ("n{k}.ipynb", '''{"cells": [{"cell_type": "markdown", "source": ["# Head {k}\\n", "Text of {n}."]}, {"cell_type": "code", "source": ["import area_{n}\\n", "def run():\\n", "    helper({k})\\n"]}]}
'''),
    "markdown": ("docs/c{k}.md", '''# Guide {k}
Text of {n}.

## Use
More text.
'''),
}


def fill(template: str) -> Column:
    values = {"{k}": F.col("c_custkey").cast("string"), "{n}": F.col("c_nationkey").cast("string")}
    return F.concat(*(values[x] if x in values else F.lit(x) for x in re.split(r"(\{[kn]\})", template) if x))


def written(g, kind: str) -> DataFrame:
    """``path, language, content`` of that kind's files."""
    path, text = FILES[kind]
    # A customer is a few bytes and its file much work: dealt over all cores, however few files and row groups the table has.
    files = spread(g.table("customer").select("c_custkey", "c_nationkey")).select(fill(path).alias("path"), fill(text).alias("content"))
    return files.select("path", T.language(F.col("path")).alias("language"), "content")


def said(g, kind: str) -> DataFrame:
    """What the adapter says of them."""
    found = facts.extract(written(g, kind))
    return found.select("path", "fact", "name", "qualified_name", "kind", F.coalesce("target", F.lit("-")).alias("target"), "start_line")


def edges(g, kind: str) -> DataFrame:
    """Unresolved edges of them."""
    return facts.edges_of(facts.extract(written(g, kind))).select("path", "source", "unresolved_target", "kind", F.round("confidence", 3).alias("confidence"))


def _lines(g) -> DataFrame:
    """Coverage with two branches on every third line, of which an uncovered line has none taken and a covered one has one."""
    third = F.col("line") % 3 == 0
    return g.coverage.select("file_id", "suite", "line", "hits", F.when(third, 2).otherwise(0).alias("branches"))


def lcov(g) -> DataFrame:
    """One report of each file and suite, as its lines in blocks of 64 source lines, read: ``report_path, suite, path, line, hits, branches_valid, branches_covered``."""
    file = F.concat(F.lit("src/s"), F.col("file_id").cast("string"), F.lit(".c"))
    name = F.concat(file, F.lit("-"), "suite", F.lit(".info")).alias("report_path")
    line = F.col("line").cast("string")
    taken = lambda n, t: F.when(F.col("branches") > 0, F.concat(F.lit("BRDA:"), line, F.lit(f",0,{n},"), t))
    own = F.array(F.concat(F.lit("DA:"), line, F.lit(","), F.col("hits").cast("string")), taken(0, F.col("hits").cast("string")), taken(1, F.lit("-")))
    body = _lines(g).select(name, (F.expr("line div 64") + 1).alias("block"), F.col("line").alias("n"), F.posexplode(own).alias("k", "value")).filter("value IS NOT NULL")
    body = body.select("report_path", "block", (F.col("n") * 4 + F.col("k")).alias("at"), "value")
    last = F.lit(1 << 40)
    ends = F.array(*(F.struct(block.cast("long").alias("block"), F.lit(at).cast("long").alias("at"), value.alias("value")) for block, at, value in (
        (F.lit(0), 0, F.concat(F.lit("TN:"), "suite")), (F.lit(0), 1, F.concat(F.lit("SF:"), file)), (last, 0, F.lit("end_of_record")))))
    heads = _lines(g).select("file_id", "suite").distinct().select(name, F.inline(ends))
    return report_lines.lcov_rows(heads.unionByName(body))


def cobertura(g) -> DataFrame:
    """The same as XML, one report a file, of the suite F."""
    half = F.when(F.col("hits") > 0, "50% (1/2)").otherwise("0% (0/2)")
    branch = F.when(F.col("branches") > 0, F.concat(F.lit(' branch="true" condition-coverage="'), half, F.lit('"'))).otherwise("")
    own = F.concat(F.lit('<line number="'), F.col("line").cast("string"), F.lit('" hits="'), F.col("hits").cast("string"), F.lit('"'), branch, F.lit("/>"))
    rows = _lines(g).filter("suite = 'F'").groupBy("file_id").agg(F.array_join(F.collect_list(own), "").alias("body"))
    file = F.concat(F.lit("src/s"), F.col("file_id").cast("string"), F.lit(".c"))
    text = F.concat(F.lit('<?xml version="1.0"?><coverage><packages><package><classes><class filename="'), file, F.lit('"><lines>'), "body", F.lit("</lines></class></classes></package></packages></coverage>"))
    return reports.read(rows.select(F.concat(file, F.lit(".xml")).alias("path"), text.alias("content"))).drop("suite")


def resolved(g, kind: str) -> DataFrame:
    """Their edges after resolution, counted by kind and by what found the target, and how many targets there are."""
    found = cut(facts.extract(written(g, kind)).select("path", "fact", "name", "qualified_name", "kind", "target", "start_line", "end_line", "ordering", "detail"))  # read once for symbols and once for edges
    file = F.xxhash64("path")
    # As many as customers, whose few bytes Spark would take for their size: never broadcast.
    files = written(g, kind).select(file.alias("id"), F.lit(1).alias("repository_id"), "language", "path").hint("merge")
    symbols = facts.symbols_of(found).select(F.xxhash64("path", "qualified_name").alias("id"), file.alias("file_id"), "name", "qualified_name", "kind")
    source = F.xxhash64("path", "source").alias("source_symbol_id")
    open_ = facts.edges_of(found).select(source, F.lit(None).cast("long").alias("target_symbol_id"), "unresolved_target", "kind", "confidence", "ordering")
    out = resolve.resolve_edges(View(files=files, symbols=symbols, edges=open_))
    return out.groupBy("kind", "stage").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("resolved_id").alias("n_targets"))
