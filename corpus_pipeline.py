"""A corpus pipeline: toxicity filter, exact dedup, near dedup, decontamination, packing.

Each stage works on all that its predecessor kept, and is written as Parquet to the shared folder before the next begins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import ensure_checkpoint_dir, remove
from graphloom.llm.queries import STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: The classifier, the similarity search and the packing can't be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces of what is left."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
