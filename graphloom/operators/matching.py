"""Theta joins on paths, prefixes and names, and metrics over sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ancestors() -> Column:
    """Of the column ``__p``: the path, all directories that enclose it, and the empty one."""
    return F.expr("transform(sequence(0, size(split(__p, '/'))), n -> array_join(slice(split(__p, '/'), 1, n), '/'))")


def owning_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """The package whose directory is the longest that encloses each file; of equals the one of the greatest position.

    Paths are exploded to their enclosing directories, so the prefix join is an equi-join.
    """
    dirs = files.withColumn("__p", F.col("path")).withColumn("dir", F.explode(_ancestors())).select("path", "dir")
    best = F.max_by("package", F.struct(F.length("dir"), F.col("position")))
    found = dirs.join(packages.select("package", "dir", "position"), "dir").groupBy("path").agg(best.alias("package"))
    return files.select("path").distinct().join(found, "path", "left")


def suffix_match(reported: DataFrame, files: DataFrame) -> DataFrame:
    """Reported path -> the first known path that is equal or where either ends with ``/`` and the other.

    Both sides are exploded to their suffixes at ``/``, so that equal keys meet instead of all pairs.
    """
    tails = lambda c: F.expr(f"transform(sequence(1, size(split({c}, '/'))), n -> array_join(slice(split({c}, '/'), n, size(split({c}, '/'))), '/'))")
    r = reported.select(F.col("path").alias("reported"), F.explode(tails("path")).alias("key"))
    k = files.select(F.col("path").alias("known"), F.explode(tails("path")).alias("key"))
    one = r.join(files.select(F.col("path").alias("known"), F.col("path").alias("key")), "key")
    two = reported.select(F.col("path").alias("reported"), F.col("path").alias("key")).join(k, "key")
    both = one.select("reported", "known").unionByName(two.select("reported", "known"))
    return both.groupBy("reported").agg(F.min("known").alias("known"))


def channel_pairs(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """Senders and receivers of one channel in different scopes, distinct. Both: scope, channel."""
    s = sends.select(F.col("scope").alias("sender"), "channel").distinct()
    r = receives.select(F.col("scope").alias("receiver"), "channel").distinct()
    return s.join(r, "channel").filter("sender <> receiver").select("sender", "receiver", "channel")


def _end_names(var: Column) -> Column:
    """What a channel's end may be called if a variable stands for it: itself, what precedes a ``.`` or ``_`` in it, what follows a ``.``."""
    places = lambda *signs: F.filter(F.sequence(F.lit(1), F.char_length(var)), lambda i: F.substr(var, i, F.lit(1)).isin(*signs))
    before = F.transform(places(".", "_"), lambda i: F.substr(var, F.lit(1), i - 1))
    behind = F.transform(places("."), lambda i: F.substr(var, i + 1))
    return F.array_distinct(F.filter(F.concat(F.array(var), before, behind), lambda x: x != ""))


def sends_to(declared: DataFrame, ends: DataFrame) -> DataFrame:
    """``file_id, sender, receiver``: scopes of one file of which one sends into a channel from which the other receives.

    ``declared``: file_id, tx, rx; ends: file_id, scope, role (``send`` or ``recv``), var. A variable stands for a declared end if it is
    its name, begins with it and ``.`` or ``_``, or ends with ``.`` and it: those names are exploded as keys, so that ends meet channels by
    equality. Sends of no declared name that are called like a sender (``tx`` or ``sender`` in the name) go to all receives called like one.
    """
    used = ends.filter("var <> ''").select("file_id", "scope", "role", "var").distinct()
    named = used.select("file_id", "scope", "role", F.explode(_end_names(F.col("var"))).alias("name"))
    channels = declared.select("file_id", "tx", "rx").distinct()
    at = lambda role, end, scope: named.filter(F.col("role") == role).select("file_id", F.col("name").alias(end), F.col("scope").alias(scope)).join(channels, ["file_id", end]).select("file_id", "tx", "rx", scope).distinct()
    pairs = at("send", "tx", "sender").join(at("recv", "rx", "receiver"), ["file_id", "tx", "rx"]).select("file_id", "sender", "receiver")
    like = lambda role, scope, *parts: used.filter((F.col("role") == role) & (F.contains("var", F.lit(parts[0])) | F.contains("var", F.lit(parts[1])))).select("file_id", "var", F.col("scope").alias(scope))
    loose = like("send", "sender", "tx", "sender").join(channels.select("file_id", F.col("tx").alias("var")).distinct(), ["file_id", "var"], "left_anti").select("file_id", "sender").distinct()
    guessed = loose.join(like("recv", "receiver", "rx", "receiver").select("file_id", "receiver").distinct(), "file_id")
    return pairs.unionByName(guessed).filter("sender <> receiver").distinct()


def channel_counts(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """Of each channel the number of pairs that ``channel_pairs`` has and the sums of their ends, without making them.

    Pairs are all senders with all receivers but those of one scope; scopes are numbers.
    """
    ends = sends.select("scope", "channel", F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(receives.select("scope", "channel", F.lit(0).alias("s"), F.lit(1).alias("r")))
    ends = ends.filter("scope is not null and channel is not null").groupBy("channel", "scope").agg(F.max("s").alias("s"), F.max("r").alias("r"))
    both, scope = F.col("s") * F.col("r"), F.col("scope")
    sums = ends.groupBy("channel").agg(
        F.sum("s").alias("n_s"), F.sum("r").alias("n_r"), F.sum(both).alias("n_both"),
        F.sum(F.col("s") * scope).alias("sum_s"), F.sum(F.col("r") * scope).alias("sum_r"), F.sum(both * scope).alias("sum_both"),
    )
    out = sums.select("channel", F.expr("n_s * n_r - n_both").alias("n_pairs"), F.expr("sum_s * n_r - sum_both").alias("sum_senders"), F.expr("sum_r * n_s - sum_both").alias("sum_receivers"))
    return out.filter("n_pairs > 0")


def set_metrics(rows: DataFrame, group: list[str], retrieved: str = "retrieved", expected: str = "expected") -> DataFrame:
    """Precision, recall and F1 on distinct sets; two empty sets agree fully, an empty retrieval of something is 0."""
    return _metrics(rows, group, F.size(F.array_intersect(retrieved, expected)), F.size(F.array_distinct(retrieved)), F.size(F.array_distinct(expected)))


def metrics_of_rows(rows: DataFrame, group: list[str], item: str = "item", retrieved: str = "retrieved", expected: str = "expected") -> DataFrame:
    """The same of sets that stand as rows: group, item, and whether it is retrieved and expected.

    No set is gathered: repeated items are one by aggregation, and of a group only three counts are kept.
    """
    flag = lambda c: F.max(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    each = rows.groupBy(*group, item).agg(flag(retrieved).alias("__r"), flag(expected).alias("__x"))
    sums = each.groupBy(*group).agg(F.sum(F.col("__r") * F.col("__x")).alias("__both"), F.sum("__r").alias("__n"), F.sum("__x").alias("__m"))
    return _metrics(sums, group, F.col("__both"), F.col("__n"), F.col("__m"))


def _metrics(rows: DataFrame, group: list[str], both: Column, n: Column, m: Column) -> DataFrame:
    share = both.cast("double")
    p = F.when((n == 0) & (m == 0), 1.0).when(n == 0, 0.0).otherwise(share / n)
    r = F.when(m == 0, 1.0).otherwise(share / m)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return rows.select(*group, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"), (both == m).alias("success"))


def similarity_target(name: Column) -> Column:
    """What a test's name stands for: the first fitting prefix or suffix off; null if nothing is left or none fits."""
    off = lambda k, end: F.expr(f"substring(name, 1, length(name) - {k})") if end else F.expr(f"substring(name, {k + 1})")
    cut = F.when(name.startswith("test_"), off(5, False)).when(name.startswith("test"), off(4, False)).when(name.startswith("Test"), off(4, False)).when(name.endswith("_test"), off(5, True)).when(name.endswith("Test"), off(4, True))
    return F.nullif(cut, F.lit(""))


def inherited_dependencies(members: DataFrame, workspace: DataFrame, locked: DataFrame) -> DataFrame:
    """Members' dependencies with the workspace's requirement where they inherit it, and the locked version if known.

    ``members``: package, name, requirement, inherits; ``workspace``: name, requirement; ``locked``: name, version.
    """
    w = workspace.select("name", F.col("requirement").alias("w"))
    rows = members.join(w, "name", "left").join(locked.select("name", F.col("version").alias("v")), "name", "left")
    return rows.select("package", "name", F.coalesce("v", F.when(F.col("inherits"), F.col("w")).otherwise(F.col("requirement"))).alias("requirement"))


def first_of_each(rows: DataFrame, key: list[str], *order: str | Column) -> DataFrame:
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__rank = 1").drop("__rank")
