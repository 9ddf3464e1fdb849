"""Each text operator with a Python function, called directly in a session whose executors don't know the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
CALLS = {
    "minhash": "minhash.drop_near_duplicates(docs)",
    "decontaminate": "decontaminate.drop_contaminated(docs, docs, item_id_col='doc_id')",
    "token_counts": "token_counts.token_counts(docs)",
    "html_extract": "html_extract.extract_text(docs, 'doc_id', 'text', 'text')",
    "packing": "packing.pack(docs)",
    "sharding": "sharding.shard(docs, 2)",
    "turns": "turns.repair_conversations(docs.selectExpr('doc_id as conv_id', '1 as turn', 'text as role', 'text'))",
    "toxicity": "toxicity.score_toxicity(docs, toxicity.train(docs, docs.selectExpr('doc_id', 'cast(doc_id % 2 as int) as toxic')))",
}
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from graphloom.llm import {module}
docs = spark.createDataFrame([(k, f"text number {{k}} of some words here and there") for k in range(6)], "doc_id long, text string")
print("rows", {call}.count())
"""


@pytest.mark.parametrize("module", CALLS)
def test_alone(module, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), module=module, call=CALLS[module])], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows" in done.stdout, done.stderr[-2000:]
