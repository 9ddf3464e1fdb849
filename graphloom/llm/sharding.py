"""Contiguous shards of near equal bytes, cut from global prefix sums.

One pass over the texts leaves narrow rows (id, size, checksum) with their running position inside their partition. The
partitions' totals, one row each, give every partition its global start, and so every row its global byte range without a
sort or a shuffle of the rows. Shard borders are equal targets in that byte line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut
from graphloom.shipping import shipped


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the bytes and rows that stand before each row in it."""
    part, bytes_before, rows_before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column(1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes) + bytes_before
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part), pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(np.arange(rows_before, rows_before + n), pa.int64())],
            names=["__id", "size", "text_crc32", "__part", "__before", "__row"],
        )
        rows_before += n
        bytes_before = int(ends[-1]) if n else bytes_before


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1, so that rows without text take room too. The law is
    ``bytes``: a row belongs to the shard in whose equal share of all bytes its middle lies; shards are contiguous in table
    order, so a shard's bytes differ from the mean by one row's size at most. ``slot`` counts a shard's rows from 0 without
    gaps. Equal texts, repeated rows and null ids are rows like any other; ``grown_shard`` is null under this law. Fewer rows
    than shards leave shards empty; an empty table gives no rows. Nothing is kept together by group.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("__id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    kind = source.schema["__id"].dataType.simpleString()
    rows = cut(shipped(source).mapInArrow(_running, f"__id {kind}, size long, text_crc32 long, __part long, __before long, __row long"))
    # One row a partition of the input: the only table that meets in one task, and the one that is broadcast.
    parts = rows.groupBy("__part").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    parts = parts.select(
        "__part",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes0"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows0"),
        F.sum("__bytes").over(every).alias("__total"),
    )
    start = F.col("__before") + F.col("__bytes0")
    # Twice the row's middle, so that all stays in whole numbers; decimals, as the product can pass 64 bits.
    middle = (2 * start + F.col("size")).cast("decimal(38,0)")
    share = F.floor(middle * F.lit(n_shards) / (2 * F.col("__total")).cast("decimal(38,0)")).cast("int")
    placed = rows.join(F.broadcast(parts), "__part").select(
        "__id", "size", "text_crc32", F.least(share, F.lit(n_shards - 1)).alias("shard"), (F.col("__row") + F.col("__rows0")).alias("__at")
    )
    firsts = placed.groupBy("shard").agg(F.min("__at").alias("__first"))  # n_shards rows at most
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__at") - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
