"""Incremental indexing as a stream: new files are diffed against the last snapshot, batch by batch.

The snapshot of content hashes is the state, kept as a table; nothing else needs to be remembered between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.incremental import diff
from graphloom.operators.matching import first_of_each


def index_batches(files: DataFrame, snapshot_path: str, changes_path: str, checkpoint: str):
    """Start a query over a stream of ``path, content_hash`` rows. Changes are appended with their batch's number.

    A batch is written to a snapshot of its own number, so that a batch which is repeated after a failure finds the snapshot
    of the one before it, and gives the same changes.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = first_of_each(batch.select("path", "content_hash"), ["path"], F.desc("content_hash"))
        known = spark.read.parquet(f"{snapshot_path}/{number - 1}") if number else spark.createDataFrame([], "path string, content_hash string")
        found = diff(rows, known.join(rows.select("path"), "path", "left_semi"))
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{changes_path}/batch={number}")
        known.join(rows.select("path"), "path", "left_anti").unionByName(rows).write.mode("overwrite").parquet(f"{snapshot_path}/{number}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
