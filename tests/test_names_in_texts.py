"""Names in texts by pieces: against looking for each name in each text."""

import random

import pytest

from graphloom.operators import resolve


@pytest.mark.parametrize("gram", [1, 3, 5])
def test_every_name_in_every_text(spark, gram):
    rnd = random.Random(gram)
    letters = "abé:.𝒳"
    names = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8))) for _ in range(120)} | {"a::b::c", "common part x", "common part y", "%", "\\E", "never there"}
    texts = [(k, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))) for k in range(60)] + [(100, None), (101, ""), (102, "the common part x and a::b::c 100%\\E")]
    texts += [(200 + k, f"common part {k} " * 30) for k in range(20)]  # a piece that many texts have
    want = sorted((k, n) for k, t in texts for n in names if t and n in t)
    docs = spark.createDataFrame(texts, "id long, text string")
    table = spark.createDataFrame([(n,) for n in names] + [("",), (None,), ("a",)], "name string")
    got = resolve.names_in_texts(docs, "id", "text", table, gram=gram)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_no_names_and_no_texts(spark):
    docs, names = spark.createDataFrame([(1, "abc")], "id long, text string"), spark.createDataFrame([("abc",)], "name string")
    assert resolve.names_in_texts(docs, "id", "text", names.limit(0)).collect() == [] and resolve.names_in_texts(docs.limit(0), "id", "text", names).collect() == []


def test_nothing_runs_in_python_or_is_collected(spark):
    docs, names = spark.range(3).selectExpr("id", "concat('abcdef', id) as text"), spark.range(3).selectExpr("concat('cdef', id) as name")
    plan = resolve.names_in_texts(docs, "id", "text", names)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "InArrow" not in plan and [j for j in joins if "BroadcastNestedLoop" in j or "Cartesian" in j] == [] and sum("SortMergeJoin" in j for j in joins) == 2


def joined_rows(plan) -> int:
    """Rows that the merge joins of an executed plan have given out."""
    kind = plan.nodeName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in kind else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if kind == "SortMergeJoin" else 0
    return own + sum(joined_rows(p) for p in below)


def test_names_of_the_same_pieces_are_not_all_tried(spark):
    """2,048 names have but 32 pieces of five characters, which every text has: the joins' rows go with the texts, not with the names."""
    rnd = random.Random(22)
    names = sorted({format(k, "012b") for k in rnd.sample(range(1 << 12), 2048)})
    texts = [(k, "".join(rnd.choice("01") for _ in range(200))) for k in range(30)]
    got = resolve.names_in_texts(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(map(tuple, got.collect())) == sorted((k, n) for k, t in texts for n in names if n in t)
    assert joined_rows(got._jdf.queryExecution().executedPlan()) <= 2 * sum(len(t) for _, t in texts)


def test_names_of_all_lengths_at_both_ends(spark):
    line = "".join(chr(0x100 + k) for k in range(90))
    names = [line[:k] for k in range(1, 91)] + [line[-k:] for k in range(1, 91)] + [line[:k] + "!" for k in range(1, 90)]
    texts = [(1, line), (1, "x" + line[:41]), (2, line[:39]), (3, line[-20:] + "\n" + line[:10] + "!"), (4, line * 3)]
    want = {(k, n) for k, t in texts for n in names if n in t}
    got = resolve.names_in_texts(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame([(n,) for n in names * 2], "name string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_links_without_symbols(spark):
    docs, symbols = spark.createDataFrame([(1, "a::b")], "id long, body string"), spark.createDataFrame([(7, "a::b"), (8, ""), (9, None)], "id long, qualified_name string")
    g = resolve._Tables(docs=docs, symbols=symbols)
    assert resolve.doc_body_links(g, symbols.filter("id > 7")).collect() == [] and [tuple(r) for r in resolve.doc_body_links(g).collect()] == [(1, 7)]
