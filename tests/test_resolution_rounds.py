"""Resolution to the end, and again after changes: against the rules applied one by one, and against a full run."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import resolve

SYMBOLS = "id long, file_id long, name string, qualified_name string, kind string"
EDGES = "source_symbol_id long, target_symbol_id long, unresolved_target string, kind string, confidence double, ordering long"


class Graph:
    def __init__(self, spark, files, symbols, edges):
        self.files = spark.createDataFrame(files, "id long, repository_id long, path string, language string")
        self.symbols = spark.createDataFrame(symbols, SYMBOLS)
        self.edges = spark.createDataFrame([(s, t, u, k, 1.0, None) for s, t, u, k in edges], EDGES)


FILES = [(1, 1, "a.rs", "rust"), (2, 1, "b.rs", "rust"), (3, 2, "c.rs", "rust")]
BASE = [(10, 1, "main", "a::main", "Function"), (11, 2, "other", "b::other", "Function"), (12, 3, "far", "c::far", "Function"), (13, 2, "helper", "b::helper", "Function"), (14, 1, "twin", "a::twin", "Function"), (15, 2, "twin", "b::twin", "Function")]


def test_rounds(spark):
    edges = [
        (10, None, "serde::de::Parse", "Calls"),  # a dependency of its package: a symbol is made
        (11, None, "serde::de::Parse", "Calls"),  # not of this package, but the made symbol has the name: exact, a round later
        (11, None, "serde::de.Parse", "Calls"),  # the same with a dot
        (11, None, "x.Parse", "Calls"),  # by the made symbol's simple name
        (11, None, "x.Parse", "Imports"),  # never by a simple name
        (12, None, "serde::de::Parse", "Calls"),  # another repository: stays open
        (11, None, "helper", "Calls"), (10, None, "twin", "Calls"), (10, None, "serde::twin", "Calls"), (11, None, "y.twin", "Calls"), (10, 13, None, "Calls"),
    ]
    owners = spark.createDataFrame([(10, 100), (11, 200), (12, 100)], "source_symbol_id long, package_id long")
    dependencies = spark.createDataFrame([(100, "serde"), (300, "x")], "package_id long, name string")
    found, made = resolve.resolve_fixpoint(Graph(spark, FILES, BASE, edges), owners, dependencies)
    got = {(r.source_symbol_id, r.unresolved_target, r.kind): (r.stage, r.resolved_id) for r in found.collect()}
    assert len(got) == 10
    parse = {r.qualified_name: r.id for r in made.filter("repository_id = 1").collect()}
    # The source's third repository owns its package's dependency too, so its symbol is made there and not found in the first.
    assert {r.qualified_name for r in made.filter("repository_id = 2").collect()} == {"serde::de::Parse"} and set(parse) == {"serde::de::Parse", "serde::twin"}
    p = parse["serde::de::Parse"]
    assert got[10, "serde::de::Parse", "Calls"] == ("external", p) and got[11, "serde::de::Parse", "Calls"] == ("exact", p)
    assert got[11, "serde::de.Parse", "Calls"] == ("dotted", p) and got[11, "x.Parse", "Calls"] == ("unique", p) and got[11, "x.Parse", "Imports"] == ("none", None)
    assert got[11, "helper", "Calls"] == ("unique", 13) and got[10, "twin", "Calls"] == ("none", None) and got[11, "y.twin", "Calls"] == ("none", None)
    back = resolve.write_back(Graph(spark, FILES, BASE, [*edges, (11, 13, None, "Calls")]), found)
    assert {(r.source_symbol_id, r.target_symbol_id): r.late for r in back.collect() if r.target_symbol_id == 13} == {(10, 13): 0, (11, 13): 0}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_give_what_a_full_run_gives(spark, seed):
    rnd = random.Random(seed)
    files = [(k, k % 2, f"f{k}.rs", "rust") for k in range(6)]
    name = lambda: f"n{rnd.randint(0, 25)}"

    def symbol(k):
        n, f = name(), rnd.randint(0, 5)
        return (k, f, n, f"m{f}::{n}", rnd.choice(["Function", "Module", "Class"]))

    def target():
        return rnd.choice([name(), f"m{rnd.randint(0, 5)}::{name()}", f"m{rnd.randint(0, 5)}.{name()}", f"self.{name()}", "*"])

    symbols = {k: symbol(k) for k in range(40)}
    edges = {(rnd.randint(0, 45), None, target(), rnd.choice(["Calls", "Imports", "ModifiedWith", "Spawns"])) for _ in range(150)} | {(1, 2, None, "Calls")}
    old = Graph(spark, files, list(symbols.values()), list(edges))
    for k in rnd.sample(range(50), 7):
        symbols[k] = symbol(k)
    for k in rnd.sample(sorted(symbols), 3):
        del symbols[k]
    kept = {e for e in sorted(edges, key=str) if rnd.random() > 0.1} | {(rnd.randint(0, 45), None, target(), "Calls") for _ in range(10)}
    new = Graph(spark, files, list(symbols.values()), list(kept))
    rows = lambda df: sorted(map(str, df.select("source_symbol_id", "kind", "unresolved_target", "resolved_id", "stage", "repository_id").collect()))
    assert rows(resolve.resolve_changed(new, resolve.resolve_edges(old), old.edges, old.symbols)) == rows(resolve.resolve_edges(new))


def test_only_edges_with_changed_names_are_resolved_again(spark, monkeypatch):
    files = [(k, 1, f"f{k}.rs", "rust") for k in range(3)]
    symbols = [(k, k % 3, f"n{k}", f"m::n{k}", "Function") for k in range(60)]
    edges = [(k, None, f"x.n{(k * 7) % 60}", "Calls") for k in range(60)]
    old = Graph(spark, files, symbols, edges)
    new = Graph(spark, files, [(*r[:2], "fresh", *r[3:]) if r[0] == 5 else r for r in symbols], edges)
    seen = []
    whole = resolve.resolve_among
    monkeypatch.setattr(resolve, "resolve_among", lambda g, e, s: seen.append(e.count()) or whole(g, e, s))
    got = resolve.resolve_changed(new, resolve.resolve_edges(old), old.edges, old.symbols)
    assert got.filter(F.col("stage") == "none").count() == 1 and got.count() == 60 and seen == [1]


def test_doc_links_are_counted_without_pairs(spark):
    class Graph:
        docs = spark.createDataFrame([(k, "Hot name" if k % 4 else "hot-NAME") for k in range(300)] + [(900, "a b"), (900, "c"), (900, "Hot name"), (901, None), (None, "c"), (902, "nothing")], "id long, title string")
        symbols = spark.createDataFrame([(k, "hot name") for k in range(400)] + [(7, "C"), (7, "A-B"), (1000, "c"), (None, "c")], "id long, name string")

    want = resolve.doc_symbol_links(Graph()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_symbols"), F.min("symbol_id").alias("first_symbol"))
    got = {r.doc_id: (r.n_symbols, r.first_symbol) for r in resolve.doc_symbol_counts(Graph()).collect()}
    assert got == {r.doc_id: (r.n_symbols, r.first_symbol) for r in want.collect()} and got[0] == (400, 0) and got[900] == (402, 0) and got[None] == (3, 7)

    class Large:  # 1,600,000,000 pairs
        docs, symbols = spark.range(40_000).withColumn("title", F.lit("a-b")), spark.range(40_000).withColumn("name", F.lit("A b"))

    assert resolve.doc_symbol_counts(Large()).agg(F.sum("n_symbols")).first()[0] == 1_600_000_000


def test_edges_are_read_once_for_their_changes(spark):
    """What is shuffled and written goes with the edges: they are made once, whatever is asked of them."""
    files = [(k, 1, f"f{k}.rs", "rust") for k in range(3)]
    symbols = [(k, k % 3, f"n{k}", f"m::n{k}", "Function") for k in range(60)]
    edges = [(k, None, f"x.n{(k * 7) % 60}", "Calls") for k in range(60)]
    old = Graph(spark, files, symbols, edges)
    new = Graph(spark, files, [(*r[:2], "fresh", *r[3:]) if r[0] == 5 else r for r in symbols], edges[:50] + [(70, None, "n1", "Calls"), (3, None, "m::n4", "Calls")])
    before, seen = resolve.resolve_edges(old).localCheckpoint(), spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    new.edges = spark.createDataFrame(new.edges.rdd.map(counted), EDGES)
    got = resolve.resolve_changed(new, before, old.edges, old.symbols).collect()
    assert seen.value == 52 and len(got) == 51  # the edge of 70 has no source
    assert sorted((r.source_symbol_id, r.unresolved_target, r.stage) for r in got if r.stage != "unique") == [(3, "m::n4", "exact"), (35, "x.n5", "none")]
