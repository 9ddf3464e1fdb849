"""Tables that grow with the input aren't broadcast, however small Spark takes them to be."""

import pytest

from graphloom.operators import resolve
from graphloom.plans import generated
from graphloom.sources.testdata import StarGraph

SF = "/root/testdata/sf0.001"


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["python", "rust", "kotlin", "swift", "fsharp", "mojo"])
def test_no_file_or_symbol_of_generated_files_is_broadcast(spark, kind):
    plan = initial_plan(generated.resolved(StarGraph(spark, SF), kind))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_targets_of_edges_in_and_outside_of_repositories(spark):
    files = spark.createDataFrame([(1, 1, "a.rs", "rust"), (2, None, "b.rs", "rust")], "id long, repository_id long, path string, language string")
    symbols = spark.createDataFrame([(10, 1, "main", "a::main", "Function"), (11, 1, "x", "a::x", "Function"), (20, 2, "main", "b::main", "Function")], "id long, file_id long, name string, qualified_name string, kind string")
    rows = [(10, None, t, k, 1.0, o) for t in ("a::x", "a.x", "y.x", "self.x", "none", "*") for k in ("Calls", "Imports") for o in (1, 2)] + [(20, None, "b::main", "Calls", 1.0, 1)]
    edges = spark.createDataFrame(rows, "source_symbol_id long, target_symbol_id long, unresolved_target string, kind string, confidence double, ordering long")
    found = resolve.resolve_edges(generated.View(files=files, symbols=symbols, edges=edges))
    got = sorted((r.source_symbol_id, r.unresolved_target, r.kind, r.ordering, r.stage) for r in found.collect())
    stage = {("a::x", "Calls"): "exact", ("a::x", "Imports"): "exact", ("a.x", "Calls"): "dotted", ("a.x", "Imports"): "dotted", ("y.x", "Calls"): "unique", ("self.x", "Calls"): "unique"}
    assert got == sorted((s, t, k, o, stage.get((t, k), "none")) for s, _, t, k, _, o in rows)
