"""Sets of covered and uncovered lines by bitmaps."""

import random

from graphloom.engine import Engine
from graphloom.operators import coverage


def plain(rows):
    """file -> (n sources, coverable, uncovered, covered)"""
    best = {}
    for f, r, s, line, hits in rows:
        if line is not None:
            k = (f, r or "", s or "", line)
            best[k] = max(best.get(k, 0), hits or 0)
    out = {}
    for f in {k[0] for k in best}:
        by = {}
        for (g, r, s, line), hits in best.items():
            if g == f:
                by.setdefault((r, s), {})[line] = hits
        known = set().union(*by.values())
        missed = set.intersection(*({n for n, h in one.items() if h == 0} for one in by.values()))
        out[f] = (len(by), sorted(known), sorted(missed), sorted(known - missed))
    return out


def test_sets_equal_the_plain_rule(spark):
    rnd = random.Random(5)
    rows = [(f, f"r{rnd.randint(0, 1)}", f"s{rnd.randint(0, 1)}", rnd.choice([0, 1, 2, 8, 9, 32768, 32769, 65536, 65537, 100_000, rnd.randint(1, 70_000)]), rnd.choice([0, 0, 1, None])) for f in range(8) for _ in range(60)]
    rows += [(50, "one", "unit", 3, 0), (50, "two", "unit", 3, 1), (51, "one", "unit", 3, 0), (51, "two", "unit", 3, 0), (52, None, None, 7, 0), (52, "x", "y", 40_000, 0), (53, "a", "b", None, 1)]
    got = coverage.line_sets(spark.createDataFrame(rows, "file_id long, report string, suite string, line long, hits long")).collect()
    assert {r.file_id: (r.n_sources, r.coverable, r.uncovered, r.covered) for r in got} == plain(rows)
    by = {r.file_id: r for r in got}
    assert by[50].covered == [3] and by[51].uncovered == [3] and by[52].uncovered == [] and 53 not in by
    assert coverage.line_sets(spark.createDataFrame([], "file_id long, report string, suite string, line long, hits long")).count() == 0


def test_engine_by_file_and_symbol(spark):
    class Graph:
        files = spark.createDataFrame([(1, "a.py"), (2, "b.py")], "id long, path string")
        symbols = spark.createDataFrame([(9, 1, "a::f", 2, 4), (8, 1, "a", 1, 9)], "id long, file_id long, qualified_name string, start_line long, end_line long")
        line_coverage = spark.createDataFrame(
            [(1, "x.info", "unit", n, h) for n, h in ((1, 0), (2, 0), (3, 1), (9, 0))] + [(1, "y.info", "unit", n, h) for n, h in ((1, 0), (2, 1), (4, 0), (9, 0))] + [(2, "x.info", None, 1, 1)],
            "file_id long, report_path string, test_suite string, line long, hits long",
        )

    e = Engine(Graph())
    one = e.coverage_sets("a.py").first()
    assert (one.n_sources, one.coverable, one.uncovered, one.covered) == (2, [1, 2, 3, 4, 9], [1, 9], [2, 3, 4])
    of = e.coverage_sets("a::f").first()
    assert (of.symbol, of.coverable, of.uncovered, of.covered) == ("a::f", [2, 3, 4], [], [2, 3, 4]) and e.coverage_sets("none").count() == 0


def test_intervals_of_every_file_are_not_repeated_for_each(spark):
    from graphloom.plans import catalogue
    from graphloom.sources.testdata import StarGraph

    lines = spark.createDataFrame([(f, "r", "s", n, n % 2) for f in (1, 2) for n in (3, 64, 9_000_000_000)], "file_id long, report string, suite string, line long, hits int")
    common = spark.createDataFrame([("a", 0, 99), ("b", 9_000_000_000, 9_000_000_009), ("none", 200, 300)], "symbol string, start_line long, end_line long")
    own = spark.createDataFrame([(f, s, a, b) for f in (1, 2) for s, a, b in (("a", 0, 99), ("b", 9_000_000_000, 9_000_000_009))], "file_id long, symbol string, start_line long, end_line long")
    for of in (coverage.symbol_coverage, coverage.symbol_line_sets):
        got, want = of(lines, common), of(lines, own)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.count() == 4
    g = StarGraph(spark, "/root/testdata/sf0.001")
    last = g.table("part").agg({"p_partkey": "max"}).first()[0]
    assert catalogue._blocks_of_parts(g).count() == last // 100 + 1 + last // 1000 + 1
