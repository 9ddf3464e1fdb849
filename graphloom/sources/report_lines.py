"""Coverage reports of any size as line rows, by built-in functions: LCOV line by line, Cobertura by Spark's XML source.

A text file is read in splits. What a line belongs to is the source file opened last before it: within a split found by a running
last value, across splits by one row a split, so that one large report is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LINE = "array<struct<_number: long, _hits: long, _branch: string, `_condition-coverage`: string>>"
_CLASS = f"_filename string, lines struct<line: {_LINE}>, methods struct<method: array<struct<lines: struct<line: {_LINE}>>>>"
COLUMNS = ["report_path", "suite", "path", "line", "hits", "branches_valid", "branches_covered"]


def _name(path: Column) -> Column:
    """A file's path as other readers give it."""
    return F.regexp_replace(path, "^file:///", "file:/")


def lcov_rows(lines: DataFrame) -> DataFrame:
    """Rows of LCOV reports. ``lines``: report_path, block, at, value, in order of block and at; a block is what one task reads.

    The last count of a line in a record holds; a record ends at ``end_of_record`` and belongs to the ``SF`` before its lines. All rows of a
    report have its last test name (``TN``), null if that is empty or there is none. Other lines, and lines outside records, are skipped.
    """
    value = F.rtrim("value")
    opened = F.when(value.startswith("SF:"), F.trim(F.substring(value, 4, 1 << 30))).when(value.contains("end_of_record"), "")
    rows = lines.withColumn("opened", opened).withColumn("ended", value.contains("end_of_record").cast("int"))
    in_block = Window.partitionBy("report_path", "block").orderBy("at")
    here = rows.withColumn("path", F.last("opened", ignorenulls=True).over(in_block)).withColumn("record", F.sum("ended").over(in_block))
    # One row a block: what is open at its end, how many records it ends; then what is open where it begins.
    ends = rows.groupBy("report_path", "block").agg(F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("at"))).alias("open_at_end"), F.sum("ended").alias("records"))
    before = Window.partitionBy("report_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("report_path", "block", F.last("open_at_end", ignorenulls=True).over(before).alias("carried"), F.coalesce(F.sum("records").over(before), F.lit(0)).alias("earlier"))
    here = here.join(carry, ["report_path", "block"]).withColumn("path", F.coalesce("path", "carried")).withColumn("record", F.col("record") + F.col("earlier")).filter("path <> ''")
    da, br = F.regexp_extract("value", r"^DA:(\d+),(-?\d+)", 1), F.regexp_extract("value", r"^BRDA:(\d+),[^,]*,[^,]*,(\S+)", 1)
    number = F.coalesce(F.nullif(da, F.lit("")), F.nullif(br, F.lit(""))).cast("long")
    is_da, taken = da != "", F.regexp_extract("value", r"^BRDA:(\d+),[^,]*,[^,]*,(\S+)", 2)
    here = here.select("report_path", "record", "path", number.alias("line"), F.when(is_da, F.regexp_extract("value", r"^DA:(\d+),(-?\d+)", 2).cast("long")).alias("hits"), F.struct("block", "at").alias("place"), F.when(br != "", (~taken.isin("-", "0")).cast("long")).alias("taken"))
    here = here.filter(F.col("line").isNotNull()).groupBy("report_path", "record", "path", "line").agg(
        F.max_by("hits", F.when(F.col("hits").isNotNull(), F.col("place"))).alias("hits"), F.count("taken").alias("branches_valid"), F.coalesce(F.sum("taken"), F.lit(0)).alias("branches_covered"))
    name = F.when(F.col("value").startswith("TN:"), F.rtrim(F.substring("value", 4, 1 << 30)))
    suites = lines.filter(F.col("value").startswith("TN:")).groupBy("report_path").agg(F.max_by(name, F.struct("block", "at")).alias("suite"))
    return here.filter("hits IS NOT NULL").join(suites, "report_path", "left").withColumn("suite", F.nullif("suite", F.lit(""))).select(*COLUMNS)


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the LCOV reports among the files of a path."""
    text = spark.read.text(path).select(_name(F.col("_metadata.file_path")).alias("report_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return lcov_rows(text)


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the Cobertura reports among the files of a path: those of classes, then those of their methods."""
    rows = spark.read.format("xml").option("rowTag", "class").schema(_CLASS).load(path).select(_name(F.col("_metadata.file_path")).alias("report_path"), "*")
    none = F.array().cast(_LINE)
    of = lambda c: F.coalesce(c, none)
    methods = F.flatten(F.transform(F.coalesce(F.col("methods.method"), F.array().cast(f"array<struct<lines: struct<line: {_LINE}>>>")), lambda m: of(m["lines"]["line"])))
    rows = rows.select("report_path", F.col("_filename").alias("path"), F.explode(F.concat(of(F.col("lines.line")), methods)).alias("x"))
    hits, both = F.coalesce("x._hits", F.lit(0)), F.col("x._condition-coverage")
    branch = F.lower(F.coalesce("x._branch", F.lit(""))) == "true"
    part = lambda k: F.nullif(F.regexp_extract(F.coalesce(both, F.lit("")), r"\((\d+)/(\d+)\)", k), F.lit("")).cast("long")
    return rows.select(
        "report_path", F.lit(None).cast("string").alias("suite"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("x._number", F.lit(0)).alias("line"), hits.alias("hits"),
        F.when(branch, F.coalesce(part(2), F.lit(1))).otherwise(0).cast("long").alias("branches_valid"), F.when(branch, F.coalesce(part(1), (hits > 0).cast("long"))).otherwise(0).cast("long").alias("branches_covered"),
    )


def read(spark: SparkSession, path: str, suite: str | None = None) -> DataFrame:
    """Lines of all reports of a path, each read as what it is: a file of the other kind has no rows. A given suite replaces what reports say."""
    rows = lcov(spark, path).unionByName(cobertura(spark, path))
    return rows.withColumn("suite", F.lit(suite)) if suite else rows
