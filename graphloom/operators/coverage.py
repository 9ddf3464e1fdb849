"""Coverage by line, symbol, suite and file; safety scores by interval containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 64
#: Lines of a file that are kept together when lines are shuffled.
STRETCH = 4096
BRANCHES = ("branches_valid", "branches_covered")


def _dealt(lines: DataFrame, key: str) -> DataFrame:
    """Lines shuffled by ``key`` and stretches of ``STRETCH`` lines (``__stretch``), so that what is grouped by both and more isn't shuffled again."""
    return lines.withColumn("__stretch", F.floor(F.col("line") / STRETCH).cast("long")).repartition(key, "__stretch")


def lines_in_intervals(lines: DataFrame, intervals: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each line with every interval of its file that encloses it. An equi-join on file and bucket of lines, then the bounds.

    ``lines``: file_id, line, …; ``intervals``: file_id, symbol, start_line, end_line. Intervals without ``file_id`` hold in every file: they aren't
    repeated for each, and lines are dealt by file and stretch first (see ``_dealt``).
    """
    spread = F.sequence((F.col("start_line") / bucket).cast("long"), (F.col("end_line") / bucket).cast("long"))
    placed = intervals.withColumn("bucket", F.explode(spread))
    if "file_id" in intervals.columns:
        placed, same = placed.withColumnRenamed("file_id", "f"), (F.col("file_id") == F.col("f")) & (F.col("own") == F.col("bucket"))
    else:
        lines, same = _dealt(lines, "file_id"), F.col("own") == F.col("bucket")
    rows = lines.withColumn("own", (F.col("line") / bucket).cast("long"))
    return rows.join(placed, same).filter("line between start_line and end_line").drop("own", "bucket", "f")


def symbol_coverage(lines: DataFrame, intervals: DataFrame) -> DataFrame:
    """Valid and covered lines of each symbol and suite; symbols without valid lines are left out."""
    rows = lines_in_intervals(lines, intervals)
    branches = [F.sum(c).alias(c) for c in BRANCHES if c in lines.columns]
    return rows.groupBy("file_id", "symbol", "suite").agg(F.count(F.lit(1)).alias("lines_valid"), F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).alias("lines_covered"), *branches)


def coverage_profile(lines: DataFrame) -> DataFrame:
    """Of each file: lines that any suite can cover, and those left uncovered by every suite's list of uncovered lines.

    A line that one suite leaves uncovered and another doesn't know isn't in all lists, and so counts as covered.
    """
    suites = lines.groupBy("file_id").agg(F.countDistinct("suite").alias("n_suites"))
    per_line = lines.groupBy("file_id", "line").agg(F.sum(F.when(F.col("hits") == 0, 1).otherwise(0)).alias("n_not"))
    rows = per_line.join(suites, "file_id")
    out = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("coverable"), F.sum(F.when(F.col("n_not") == F.col("n_suites"), 1).otherwise(0)).alias("uncovered"))
    return out.withColumn("covered", F.col("coverable") - F.col("uncovered")).withColumn("percent", F.round(F.col("covered").cast("double") / F.col("coverable") * 100.0, 6))


def line_sets(lines: DataFrame, target: str | tuple[str, ...] = "file_id", sources: tuple[str, ...] = ("report", "suite")) -> DataFrame:
    """Of each target: how many sources (reports and suites) know it, and the sorted lists ``coverable``, ``uncovered`` and ``covered``.

    Coverable is what any source knows, uncovered what every source of the target leaves uncovered; what one leaves uncovered and
    another doesn't know counts as covered. ``lines``: target, sources, line, hits; of a line that a source has more than once the most
    hits count, null hits are none, and a source's null is an empty text. Lines are counted over sources within stretches of a target, whose
    lists are put together at the end: the work goes with the lines there are, and not with how far apart they lie.
    """
    keys = [target] if isinstance(target, str) else list(target)
    rows = lines.filter(F.col(keys[0]).isNotNull() & F.col("line").isNotNull()).withColumn("line", F.col("line").cast("long"))
    rows = rows if "__stretch" in lines.columns else _dealt(rows, keys[0])
    source = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sources)).alias("source")
    each = rows.select(*keys, "__stretch", "line", source, "hits").groupBy(*keys, "__stretch", "line", "source").agg(F.max(F.coalesce("hits", F.lit(0))).alias("hits"))
    each = each.groupBy(*keys, "__stretch", "line").agg(F.collect_list("source").alias("by"), F.count_if(F.col("hits") == 0).alias("n"))
    # Only what all sources of a line leave uncovered can be uncovered by all of the target's.
    missed = F.when(F.col("n") == F.size("by"), F.struct("line", "n"))
    parts = each.groupBy(*keys, "__stretch").agg(F.array_sort(F.collect_list("line")).alias("known"), F.array_sort(F.collect_list(missed)).alias("missed"), F.array_distinct(F.flatten(F.collect_list("by"))).alias("by"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__stretch", "known", "missed"))).alias("p"), F.size(F.array_distinct(F.flatten(F.collect_list("by")))).cast("long").alias("n_sources"))
    uncovered = F.transform(F.filter(F.flatten(F.transform("p", lambda x: x["missed"])), lambda x: x["n"] == F.col("n_sources")), lambda x: x["line"])
    out = whole.select(*keys, "n_sources", F.flatten(F.transform("p", lambda x: x["known"])).alias("coverable"), uncovered.alias("uncovered"))
    return out.withColumn("covered", F.array_except("coverable", "uncovered"))


def symbol_line_sets(lines: DataFrame, intervals: DataFrame) -> DataFrame:
    """``line_sets`` of each symbol (file_id, symbol): of the lines of its file that lie within it."""
    return line_sets(lines_in_intervals(lines, intervals), ("file_id", "symbol"))


def branch_coverage(lines: DataFrame, *group: str) -> DataFrame:
    """Branches of each group by its suite that covers the most of them; of equals the last by name. Lines without branches count none."""
    sums = lines.groupBy(*group, "suite").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in BRANCHES))
    best = F.max_by(F.struct("suite", *BRANCHES), F.struct("branches_covered", "suite"))
    return sums.groupBy(*group).agg(best.alias("b")).select(*group, "b.*")


def uncovered_spans(lines: DataFrame) -> DataFrame:
    """Runs of consecutive uncovered lines of each file and suite."""
    rows = lines.filter("hits = 0").withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy("file_id", "suite").orderBy("line")))
    return rows.groupBy("file_id", "suite", "island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line")).drop("island")


def safety_score(ffi: Column, unsafe_functions: Column, exposed: Column, wrapped: Column) -> Column:
    """100 less 15, 10, 5 and 2 for each, within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - 15 * ffi - 10 * unsafe_functions - 5 * exposed - 2 * wrapped))


def risk(score: Column) -> Column:
    return F.when(score >= 90, "Low").when(score >= 60, "Medium").otherwise("High")


def contained(blocks: DataFrame, functions: DataFrame, group: str, width: int = 1024) -> DataFrame:
    """Blocks (start, end) that lie inside some function interval (lo, hi) of the same group; each block row at most once.

    A block lies inside one if the greatest ``hi`` of all intervals that begin no later than it is not before its end: a running
    maximum instead of a join, so no pairs are made. It is taken within stretches of ``width`` and over the stretches
    before, so that a large group is dealt over many tasks. Rows with a null among these columns match nothing.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long").alias("__cell")
    f = functions.dropna(subset=[group, "lo", "hi"]).select(F.col(group).alias("__g"), cell("lo"), F.col("lo").alias("__at"), F.lit(0).alias("__block"), F.col("hi").alias("__hi"))
    b = blocks.dropna(subset=[group, "start", "end"])
    b = b.select(F.col(group).alias("__g"), cell("start"), F.col("start").alias("__at"), F.lit(1).alias("__block"), F.lit(None).cast(functions.schema["hi"].dataType).alias("__hi"), F.struct(*blocks.columns).alias("__row"))
    rows = f.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy("__g").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("__g", "__cell").agg(F.max("__hi").alias("__most")).select("__g", "__cell", F.max("__most").over(before).alias("__earlier"))
    so_far = Window.partitionBy("__g", "__cell").orderBy("__at", "__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("__here", F.max("__hi").over(so_far)).filter("__block = 1").join(cells, ["__g", "__cell"])
    return placed.filter(F.greatest("__here", "__earlier") >= F.col("__row")["end"]).select("__row.*")


def safety_profile(blocks: DataFrame, functions: DataFrame, ffi: DataFrame, group: str, width: int = 1024) -> DataFrame:
    """Counts, score and risk of each group. A block inside an unsafe function is exposed, another is wrapped."""
    inside = contained(blocks, functions, group, width).groupBy(group).agg(F.count(F.lit(1)).alias("exposed"))
    counts = [df.groupBy(group).agg(F.count(F.lit(1)).alias(n)) for df, n in ((blocks, "blocks"), (functions, "unsafe_functions"), (ffi, "ffi"))]
    out = counts[0].join(counts[1], group, "full").join(counts[2], group, "full").join(inside, group, "full").na.fill(0)
    out = out.withColumn("wrapped", F.col("blocks") - F.col("exposed"))
    out = out.withColumn("score", safety_score(F.col("ffi"), F.col("unsafe_functions"), F.col("exposed"), F.col("wrapped")).cast("long"))
    share = F.when(F.col("blocks") > 0, F.round(F.col("wrapped").cast("double") / F.col("blocks") * 100.0, 6)).otherwise(100.0)
    return out.withColumn("risk", risk(F.col("score"))).withColumn("safe_wrapper_percent", share)
