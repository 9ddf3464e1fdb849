"""Snapshots and changes: diff by content hash, last-write-wins upserts, cascading deletes, replaced reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(found: DataFrame, known: DataFrame) -> DataFrame:
    """``path, status`` (new, changed, unchanged, deleted) by a full outer join. A file without a known hash has changed."""
    k = known.select(F.col("path").alias("old_path"), F.col("content_hash").alias("old_hash"))
    rows = found.join(k, F.col("path") == F.col("old_path"), "full")
    status = (
        F.when(F.col("old_path").isNull(), "new").when(F.col("path").isNull(), "deleted")
        .when(F.col("content_hash") == F.col("old_hash"), "unchanged").otherwise("changed")
    )
    return rows.select(F.coalesce("path", "old_path").alias("path"), status.alias("status"))


def run_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))


def upsert(rows: DataFrame, key: list[str], order: str, id_col: str = "id") -> DataFrame:
    """The last write of each key, under the id of the first."""
    others = [c for c in rows.columns if c not in key and c != id_col]
    # Two values a key, which each task has for its own rows before they are shuffled.
    last = F.max_by(F.struct(*others), F.struct(order)).alias("__last")
    return rows.groupBy(*key).agg(F.min_by(id_col, order).alias(id_col), last).select(*key, id_col, "__last.*").select(*rows.columns)


def delete_files(edges: DataFrame, symbols: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges after files have gone: those of their symbols go, those to their symbols become unresolved names again."""
    doomed = symbols.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("id").alias("d"), F.col("qualified_name").alias("q"))
    kept = edges.join(doomed, F.col("source_symbol_id") == F.col("d"), "left_anti").join(doomed, F.col("target_symbol_id") == F.col("d"), "left")
    back = kept.select("source_symbol_id", F.when(F.col("d").isNull(), F.col("target_symbol_id")).alias("target_symbol_id"), F.coalesce("q", "unresolved_target").alias("unresolved_target"), "kind")
    return back.distinct()


def replace_reports(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows of other reports, and the new ones; absent suites are one suite."""
    names = new.select(*[F.col(c).alias(f"__{c}") for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return old.join(names, same, "left_anti").unionByName(new)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
