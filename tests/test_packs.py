"""Packs of many targets at once against the plain rule, and operators in a session whose executors don't know the package."""

import os
import random
import subprocess
import sys
from pathlib import Path

from graphloom.operators import context

ROOT = Path(__file__).resolve().parent.parent


def test_packs_equal_the_plain_rule(spark):
    rnd = random.Random(2)
    rows = [(t, s, p, f"item {p}", rnd.choice([0, 1, 3, 8, 20])) for t in range(40) for s in range(7) for p in range(rnd.choice([0, 1, 3, 9]))]
    rows += [(99, 2, p, f"x{p % 5}", 2) for p in [*range(3000), 7, 7]]  # a hub, with repeated items
    items = spark.createDataFrame(rows, "target long, section int, position int, item string, tokens long")
    for budget in (0, 1, 17, 60, None):
        want = []
        for t in {r[0] for r in rows}:
            own = sorted((r[1], r[2], r[3], max(1, r[4]) if budget is not None else r[4]) for r in rows if r[0] == t)
            keep = context.fit([(r[0], r[3]) for r in own], budget)
            want += [(t, *r) for r, k in zip(own, keep, strict=True) if k]
        assert sorted(map(tuple, context.pack(items, budget).collect())) == sorted(want), budget


def test_packs_use_no_python(spark):
    items = spark.createDataFrame([(1, 1, 1, "a", 1)], "target long, section int, position int, item string, tokens long")
    plan = context.rendered(context.pack(items, 10))._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "InPandas" not in plan and "WindowGroupLimit" in plan


FRESH = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from graphloom.operators import context, resolve
docs = spark.createDataFrame([(1, "calls a::b and c"), (2, None)], "id long, body string")
names = spark.createDataFrame([("a::b",), ("",), ("zz",)], "name string")
assert [tuple(r) for r in resolve.names_in_texts(docs, "id", "body", names).collect()] == [(1, "a::b")]
items = spark.createDataFrame([(1, 1, 1, "a", 5), (1, 2, 1, "b", 9)], "target long, section int, position int, item string, tokens long")
assert [r.item for r in context.pack(items, 10).collect()] == ["a"]
print("fine")
"""


def test_operators_in_a_session_of_their_own(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", FRESH.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
