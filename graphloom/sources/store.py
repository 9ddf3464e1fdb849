"""Fact tables on disk: a folder of Parquet tables for each index run, and a manifest that makes a run visible.

A run writes its tables under ``run=<number>`` and its manifest last, so readers see whole runs only; a run that fails leaves
files that no manifest names. The manifest says in which run's folder each table lies: tables that a run doesn't write are
carried over without being copied. Two runs of one number can't both end: the second one finds the folder taken.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.fulltext import TextIndex
from graphloom.operators.incremental import row_counts
from graphloom.schema import SCHEMAS

#: Tables beside the fact tables: what the adapters said, and where the docs and repositories lie.
EXTRA = {
    "facts": "path string, fact string, name string, qualified_name string, kind string, target string, start_line long, end_line long, ordering long, detail map<string,string>",
    "generated_symbols": "symbol_id long, provenance string",
}
_MANIFEST = "table_name string, run long"
#: Tables that have a full-text index, and its columns.
INDEXED = {"docs": ("title", "body"), "symbols": ("name", "qualified_name")}


class FactStore:
    """Versions of the fact tables in a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, path = self._path()
        names = [str(x.getPath().getName()) for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removeprefix("run=")) for n in names if n.startswith("run="))

    def _done(self, number: int) -> bool:
        fs, path = self._path(f"run={number}/manifest/_SUCCESS")
        return fs.exists(path)

    def latest(self) -> int | None:
        """Number of the last whole run."""
        return next((n for n in reversed(self._numbers()) if self._done(n)), None)

    def manifest(self, number: int | None = None) -> dict[str, int]:
        """Table -> run whose folder holds it; some two dozen rows."""
        number = self.latest() if number is None else number
        if number is None:
            return {}
        return {r.table_name: r.run for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/run={number}/manifest").collect()}

    def table(self, name: str, manifest: dict[str, int] | None = None) -> DataFrame:
        """A table of the last whole run; without rows if no run has written it."""
        schema = (SCHEMAS | EXTRA)[name]
        at = (self.manifest() if manifest is None else manifest).get(name)
        return self.spark.createDataFrame([], schema) if at is None else self.spark.read.schema(schema).parquet(f"{self.root}/run={at}/{name}")

    def text_index(self, name: str) -> TextIndex:
        return TextIndex(self.spark, f"{self.root}/index-{name}", INDEXED[name])

    def refresh_index(self, name: str) -> None:
        """Bring a table's full-text index up to the last whole run: rows that are gone or differ from the run at which it was are replaced.

        If it was never written, or that run is gone, it is written anew from all rows.
        """
        index, last = self.text_index(name), self.latest()
        fs, mark = self._path(f"index-{name}-at")
        at = self.spark.read.schema("run long").parquet(f"{self.root}/index-{name}-at").first() if fs.exists(mark) else None
        if last is None or (at is not None and at.run == last):
            return
        columns = INDEXED[name]
        rows = lambda manifest: self.table(name, manifest).select("id", *columns, F.xxhash64(*columns).alias("hash"))
        now = rows(self.manifest(last))
        if at is None or not self._done(at.run):
            index_fs, path = self._path(f"index-{name}")
            index_fs.delete(path, True)
            index.add(now)
        else:
            before = rows(self.manifest(at.run)).select("id", "hash")
            index.delete(before.join(now.select("id"), "id", "left_anti").select("id"))
            index.add(now.join(before, ["id", "hash"], "left_anti"))
        self.spark.createDataFrame([(last,)], "run long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/index-{name}-at")

    def begin(self) -> Run:
        numbers = self._numbers()
        return Run(self, (numbers[-1] if numbers else 0) + 1, self.manifest())

    def reset(self) -> None:
        """Delete all runs."""
        fs, path = self._path()
        fs.delete(path, True)

    def vacuum(self) -> list[int]:
        """Delete the runs that the last whole one doesn't refer to; returns their numbers. Not while others read or write."""
        last = self.latest()
        if last is None:
            return []
        gone = [n for n in self._numbers() if n < last and n not in self.manifest(last).values()]
        for n in gone:
            fs, path = self._path(f"run={n}")
            fs.delete(path, True)
        return gone

    def row_counts(self) -> DataFrame:
        """``table_name, n_rows`` of every fact table, 0 for those that were never written."""
        manifest = self.manifest()
        return row_counts({n: self.table(n, manifest) for n in SCHEMAS})


class Run:
    """One run's writes. Nothing is visible before ``finish``."""

    def __init__(self, store: FactStore, number: int, before: dict[str, int]):
        self.store, self.number, self.before, self.written = store, number, before, {}

    def old(self, name: str) -> DataFrame:
        """A table as the run before left it."""
        return self.store.table(name, self.before)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a fact table with its schema's columns, and read it again. Columns that ``rows`` lacks are null."""
        typed = self.store.spark.createDataFrame([], (SCHEMAS | EXTRA)[name]).schema
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in typed]
        rows.select(*columns).write.parquet(f"{self.store.root}/run={self.number}/{name}")
        self.written[name] = self.number
        return self.store.table(name, self.written)

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Write rows that only this run needs, and read them again: cuts the lineage."""
        path = f"{self.store.root}/run={self.number}/_stage_{name}"
        rows.write.parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def finish(self) -> None:
        rows = list((self.before | self.written).items())
        self.store.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.store.root}/run={self.number}/manifest")
        fs, _ = self.store._path()
        for status in fs.listStatus(self.store._path(f"run={self.number}")[1]):
            if str(status.getPath().getName()).startswith("_stage_"):
                fs.delete(status.getPath(), True)


class StoredGraph:
    """The last whole run's tables under the names that the operators and ``Engine`` use."""

    def __init__(self, store: FactStore):
        self.store, self._manifest = store, store.manifest()

    def table(self, name: str) -> DataFrame:
        return self.store.table(name, self._manifest)

    def text_index(self, name: str) -> TextIndex | None:
        """A table's full-text index; none if it wasn't written."""
        index = self.store.text_index(name)
        return index if index.generations() else None

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS or name in EXTRA:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("docs").join(self.table("files").select(F.col("id").alias("file_id"), "path"), "file_id", "left")

    @property
    def commits(self) -> DataFrame:
        return self.table("git_commits")

    @property
    def commit_files(self) -> DataFrame:
        return self.table("git_commit_files").withColumnRenamed("file_path", "item")

    @property
    def commit_symbols(self) -> DataFrame:
        return self.table("git_commit_symbols").withColumnRenamed("symbol_qualified_name", "item")

    @property
    def coverage(self) -> DataFrame:
        return self.table("line_coverage").groupBy("file_id", F.coalesce("test_suite", F.lit("")).alias("suite"), "line").agg(F.max("hits").alias("hits"), F.max("branches_valid").alias("branches_valid"), F.max("branches_covered").alias("branches_covered"))
