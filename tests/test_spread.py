"""Generated files are dealt over all cores, and read once."""

from graphloom.plans import generated
from graphloom.sources import facts, scanners
from graphloom.sources.testdata import StarGraph


def test_files_of_one_small_table_are_read_by_many_tasks(spark, tmp_path):
    spark.range(4000).selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    found = generated.said(StarGraph(spark, str(tmp_path)), "fsharp")
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_edges_are_made_in_one_pass(spark):
    files = spark.createDataFrame([("a.py", "python", "def helper():\n    pass\n\ndef test_helper():\n    helper()\n")], "path string, language string, content string")
    edges = facts.edges_of(facts.extract(files))
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r.unresolved_target, r.confidence) for r in edges.filter("kind = 'TestedBy'").collect()] == [("helper", 0.8)]


def test_patterns_are_tried_only_where_they_can_fit(monkeypatch):
    tried = []
    monkeypatch.setattr(scanners.re, "finditer", lambda p, line: tried.append(line) or iter(()))
    list(scanners.extract("kotlin", "a.kt", "\n".join(["x = 1"] * 50)))
    assert tried == []
