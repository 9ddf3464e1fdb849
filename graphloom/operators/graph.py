"""Graph traversal over resolved edges: bounded breadth-first search, impact, neighbourhood, call order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import COMBINATORS, CONTEXT_KINDS, IMPACT_KINDS



def hops(edges: DataFrame, kinds: tuple[str, ...], forward: bool) -> DataFrame:
    """``at, to``: the distinct steps in one direction."""
    kept = edges.filter(F.col("kind").isin(*kinds) & F.col("target_symbol_id").isNotNull())
    a, b = ("source_symbol_id", "target_symbol_id") if forward else ("target_symbol_id", "source_symbol_id")
    return kept.select(F.col(a).alias("at"), F.col(b).alias("to")).distinct()


def traverse(edges: DataFrame, start: DataFrame, kinds: tuple[str, ...] = IMPACT_KINDS, forward: bool = True, depth: int = 2) -> DataFrame:
    """``id, depth``: nodes within ``depth`` steps of the start ids, the start at 0, each with its least depth.

    A join of the frontier for each step, and an anti-join against what has been seen, so paths don't multiply at hubs. The
    plan grows with ``depth`` only, which is small; for deep searches cut the lineage between steps.
    """
    step = hops(edges, kinds, forward)
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for k in range(1, depth + 1):
        found = step.join(frontier.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("to").alias("id")).distinct()
        frontier = found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(frontier)
    return seen


def reached_edges(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = IMPACT_KINDS, forward: bool = True, depth: int = 2) -> DataFrame:
    """Edges that leave a node of less than the greatest depth, also those to nodes already visited."""
    inner = nodes.filter(F.col("depth") < depth).select(F.col("id").alias("n"))
    side = "source_symbol_id" if forward else "target_symbol_id"
    kept = edges.filter(F.col("kind").isin(*kinds) & F.col("target_symbol_id").isNotNull())
    return kept.join(inner, F.col(side) == F.col("n"), "left_semi").select("source_symbol_id", "target_symbol_id", "kind").distinct()


def impact(g, start: DataFrame, depth: int = 2) -> DataFrame:
    """``id, direction, depth`` of what the start symbols reach (down) and what reaches them (up)."""
    down = traverse(g.edges, start, forward=True, depth=depth).withColumn("direction", F.lit("down"))
    return down.unionByName(traverse(g.edges, start, forward=False, depth=depth).withColumn("direction", F.lit("up")))


def impact_tests(g, links: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """Tests of the start symbols and of all that reaches them. ``links``: source (test), target (production)."""
    up = traverse(g.edges, start, forward=False, depth=depth).select("id")
    return links.join(up, F.col("target_symbol_id") == F.col("id")).select(F.col("source_symbol_id").alias("test_id"), F.col("target_symbol_id").alias("linked_id")).distinct()


def impact_docs(g, start: DataFrame, depth: int = 2) -> DataFrame:
    """Docs of all symbols in either direction."""
    nodes = impact(g, start, depth).select("id").distinct()
    return g.docs.join(nodes.withColumnRenamed("id", "symbol_id"), "symbol_id").select(F.col("id").alias("doc_id"), "symbol_id").distinct()


def neighbourhood(g, start: DataFrame) -> DataFrame:
    """Symbols one step away in either direction."""
    both = traverse(g.edges, start, CONTEXT_KINDS, True, 1).unionByName(traverse(g.edges, start, CONTEXT_KINDS, False, 1))
    return both.groupBy("id").agg(F.min("depth").alias("depth"))


def call_order(calls: DataFrame, scope: str, *position: str) -> DataFrame:
    """0-based rank of each call in its scope by position."""
    return calls.withColumn("ordinal", F.row_number().over(Window.partitionBy(scope).orderBy(*position)) - 1)


def pipeline_steps(calls: DataFrame, scope: str, order: str, name: str, target: Column) -> DataFrame:
    """Steps of each scope without combinators, equal neighbours once; steps after the last target step are marked.

    ``target``: a condition on a row; its last row in a scope is the target, later ones are what fails with it.
    """
    w = Window.partitionBy(scope).orderBy(order)
    kept = calls.filter(~F.col(name).isin(*COMBINATORS)).withColumn("before", F.lag(name).over(w))
    kept = kept.filter(~F.col("before").eqNullSafe(F.col(name))).withColumn("step", F.row_number().over(w) - 1)
    last = F.max(F.when(target, F.col("step"))).over(Window.partitionBy(scope))
    mark = F.when(F.col("step") == last, "target").when(F.col("step") > last, "after").otherwise("before")
    return kept.select(scope, "step", F.col(name).alias("name"), F.when(last.isNull(), "before").otherwise(mark).alias("mark"))
