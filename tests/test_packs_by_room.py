"""Packs made section by section against packs of all items."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import context
from graphloom.plans.catalogue import View
from graphloom.sources.testdata import StarGraph


def graph(spark, seed):
    rnd = random.Random(seed)
    symbols = [(k, rnd.choice(["Class", "Function", None]), rnd.choice([None, "a" * rnd.randint(0, 30), f"m::{'n' * rnd.randint(0, 9)}{k % 20}"])) for k in range(60)] + [(3, "Class", "twin of 3"), (9, "Class", "twin of 9")]
    edges = {(rnd.randint(0, 64), rnd.choice([None, *range(65)]), rnd.choice(["Calls", "Imports", "Extends"])) for _ in range(400)} | {(7, k, "Calls") for k in range(60)}
    docs = [(rnd.choice([None, *range(60)]), rnd.choice([None, "", "d" * rnd.randint(1, 40)])) for _ in range(120)]
    links = {(rnd.randint(0, 64), rnd.randint(0, 64)) for _ in range(300)}
    return View(
        symbols=spark.createDataFrame(symbols, "id long, kind string, qualified_name string"),
        edges=spark.createDataFrame([(s, t, None if t is not None else "x", k) for s, t, k in edges], "source_symbol_id long, target_symbol_id long, unresolved_target string, kind string"),
        docs=spark.createDataFrame(docs, "symbol_id long, path string"),
    ), spark.createDataFrame(sorted(links), "source_symbol_id long, target_symbol_id long"), spark.createDataFrame([(k,) for k in [*range(0, 70, 3), 7, 7, 9]], "id long")


@pytest.mark.parametrize("seed", [1, 2])
def test_packs_by_room_equal_packs_of_all_items(spark, seed):
    g, links, targets = graph(spark, seed)
    every = context.items(g, targets, links, ("Calls", "Imports")).cache()
    for budget in (0, 9, 40, 200, None):
        got = sorted(map(tuple, context.packs(g, targets, links, budget, ("Calls", "Imports")).collect()))
        assert got == sorted(map(tuple, context.pack(every, budget).collect())) and got, budget


def test_what_has_no_room_is_not_shuffled(spark):
    """Of 3,000 tests of each of 40 neighbours, which don't fit, at most one a task goes on."""
    symbols = spark.range(4000).select("id", F.when(F.col("id") == 0, "Class").otherwise("Function").alias("kind"), F.format_string("a::long name of a test %06d", "id").alias("qualified_name"))
    edges = spark.range(1, 41).select(F.lit(0).cast("long").alias("source_symbol_id"), F.col("id").alias("target_symbol_id"), F.lit(None).cast("string").alias("unresolved_target"), F.lit("Calls").alias("kind"))
    links = spark.range(120_000).select((F.col("id") % 3000 + 1000).alias("source_symbol_id"), (F.expr("id div 3000") + 1).alias("target_symbol_id"))
    g = View(symbols=symbols, edges=edges, docs=spark.createDataFrame([], "symbol_id long, path string"))
    packed = context.packs(g, symbols.filter("id = 0").select("id"), links, 20)
    assert packed.count() == 2  # itself, and one neighbour; no other item is shorter than what is left
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "min(item" in plan and "WindowGroupLimit" in plan


def test_packs_of_the_tables_equal_those_of_all_items(spark):
    g = StarGraph(spark, "/root/testdata/sf0.001")
    from graphloom.operators import resolve

    targets, links = g.symbols.filter("kind = 'Class'"), resolve.direct_call_tests(g)
    assert context.packs(g, targets, links, 400).exceptAll(context.pack(context.items(g, targets, links), 400)).count() == 0


def test_edges_of_targets_are_read_once(spark):
    g, links, targets = graph(spark, 3)
    seen, schema, n = spark.sparkContext.accumulator(0), g.edges.schema, g.edges.count()

    def counted(row):
        seen.add(1)
        return row

    g.edges = spark.createDataFrame(g.edges.rdd.map(counted), schema)
    context.packs(g, targets, links, 40).collect()
    assert seen.value == 2 * n  # once for either end
