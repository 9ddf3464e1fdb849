"""Exact duplicates by progressive refinement: length, then a hash of a prefix, then a hash of the whole text.

A first scan keeps 24 bytes a row: id, byte length and the hash of the first bytes. Groups are counted on that narrow
table alone, first by length, then by length and prefix hash. Only rows of groups that survive both have their whole text
read by the digest in the second scan. All groups are counted by partial aggregation, so a group that holds a third of all
rows costs each task one record, and no group is ever gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, sieve_join, text_or_empty

PREFIX_CHARS = 256


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``__id, __len`` (UTF-8 bytes) ``, __prefix`` (64-bit hash of the first characters) of every row."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("__id"),
        F.octet_length(text).alias("__len"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("__prefix"),
    )


def refine(narrow: DataFrame) -> DataFrame:
    """(length, prefix hash) groups of more than one row, counted after single lengths have gone."""
    lengths = narrow.groupBy("__len").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__len")
    groups = sieve_join(narrow, lengths, "__len").groupBy("__len", "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    return groups.filter("__n > 1").select("__len", "__prefix")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id, __len, __prefix, text_sha256`` of the rows whose length and prefix hash occur more than once, and few others.

    Only these have their whole text read by the digest. The rows are as narrow as their key.
    """
    pairs = cut(refine(cut(signatures(docs, id_col, text_col))))
    text = text_or_empty(text_col)
    wide = docs.select(
        F.col(id_col).alias("__id"),
        F.octet_length(text).alias("__len"),
        F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("__prefix"),
        text.alias("__text"),
    )
    return sieve_join(wide, pairs, "__len", "__prefix").select("__id", "__len", "__prefix", F.sha2("__text", 256).alias("text_sha256"))


def groups_of(rows: DataFrame) -> DataFrame:
    """``text_sha256, keep_id, group_size`` of each text that occurs more than once among the candidates; the largest id stays."""
    groups = rows.groupBy("text_sha256", "__len").agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return cut(groups.filter("group_size > 1").drop("__len"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after no change; null counts as empty text, so null and empty texts form one group. Of a
    group the row with the largest id stays. Repeated rows (same id and text) count in ``group_size`` and are all marked as
    kept when theirs is the largest id; null ids never stay beside a row with an id. An empty table gives no rows. Other
    columns, whatever their names, are ignored.

    The groups come from the refinement; the last scan only adds each row's digest, which is part of the result, and looks its
    group up. That lookup is a merge join, whose large partitions the adaptive planner splits.
    """
    groups = groups_of(candidates(docs, id_col, text_col))
    rows = docs.select(F.col(id_col), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"))
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    # By merge, as only then are large partitions split; a broadcast join that is chosen after the shuffle leaves them whole.
    return rows.join(groups.hint("merge"), "text_sha256", "left").select(
        F.col(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col(id_col).eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; which ones and how nulls and repeated rows count as in ``exact_dedup``.

    Rows that go are found on narrow rows (id, length, prefix hash, digest) of the candidates alone. Rows of ``docs`` that
    certainly don't go are then passed on where they were read, without a digest or a shuffle. The few others, by and large those
    that go, are told apart by a join of whole rows. With more rows to drop than the sieve has buckets more rows take that way.
    """
    rows = cut(candidates(docs, id_col, text_col))
    # Repeated rows stay in the join: an aggregation above would hold a text's rows together.
    lost = rows.join(groups_of(rows).hint("merge"), "text_sha256").filter(~F.col("__id").eqNullSafe(F.col("keep_id")))
    lost = cut(lost.select(F.col("__id").alias("__lost_id"), "__len", "__prefix", F.col("text_sha256").alias("__lost_sha")))
    text, own = text_or_empty(text_col), ["__own_id", "__len", "__prefix"]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")  # whatever the columns' names are
    keyed = docs.select(row, F.col(id_col).alias("__own_id"), F.octet_length(text).alias("__len"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("__prefix"))
    of = lost.select(F.col("__lost_id").alias("__own_id"), "__len", "__prefix")
    doubtful = sieve_join(keyed, of, *own).withColumn("__sha", F.sha2(text_or_empty(f"__row.{text_col}"), 256))
    hit = F.col("__own_id").eqNullSafe(F.col("__lost_id")) & (F.col("__sha") == F.col("__lost_sha"))
    kept = doubtful.join(lost.select("__lost_id", "__lost_sha").hint("merge"), hit, "left_anti")
    return sieve_join(keyed, of, *own, anti=True).select("__row.*").unionByName(kept.select("__row.*"))
