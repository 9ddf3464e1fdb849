"""Helpers that the text operators share.

Nothing here collects rows: the largest thing that reaches the driver is a set of ``2 ** SIEVE_BITS`` bucket numbers.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.shipping import ship

__all__ = ["as_bytes", "bucket_of", "by_bytes", "cut", "ensure_checkpoint_dir", "remove", "ship", "sieve_join", "text_or_empty"]

#: Buckets of a sieve: at most this many small integers (some 16 MB) are ever broadcast by it.
SIEVE_BITS = 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; only a single-machine session without it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
    sc.setCheckpointDir(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that a lost executor costs one stage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bucket_of(*keys: Column | str) -> Column:
    """The sieve bucket of a key: an int in [0, 2 ** SIEVE_BITS)."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << SIEVE_BITS)).cast("int")


def sieve_join(rows: DataFrame, survivors: DataFrame, *keys: str, anti: bool = False) -> DataFrame:
    """Rows whose key *may* be among ``survivors`` (all true ones, and few others), without a shuffle of ``rows``.

    The survivors' keys are reduced to bucket numbers, of which there are at most ``2 ** SIEVE_BITS``: that is the bound
    on what is broadcast. With more survivors the sieve lets more rows pass, never fewer, so an exact step must follow.
    ``anti``: instead the rows that certainly aren't among the survivors.
    """
    buckets = survivors.select(bucket_of(*keys).alias("__bucket")).distinct()
    rows = rows.withColumn("__bucket", bucket_of(*keys))
    return rows.join(F.broadcast(buckets), "__bucket", "left_anti" if anti else "left_semi").drop("__bucket")


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` bytes of text in ``column`` (or one longer row), without a copy.

    What a worker turns into Python objects at once is thus bounded by bytes, not by a number of rows.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(sizes + 64), 0  # an object takes some bytes besides
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def as_bytes(column: pa.Array) -> pa.Array:
    """The column's UTF-8 bytes, without a copy."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in the shared store, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
