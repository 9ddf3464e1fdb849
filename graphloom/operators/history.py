"""Version-control history: churn, authors, last commits, co-change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def churn(items: DataFrame) -> DataFrame:
    """Distinct commits of each item. ``items``: commit_id, item, distinct."""
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("churn"))


def author_frequency(items: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits of each author to each item, and the author's share of them in per cent."""
    rows = items.join(commits.select(F.col("id").alias("commit_id"), "author_name", "author_email"), "commit_id")
    counts = rows.groupBy("item", F.concat("author_name", F.lit(" <"), "author_email", F.lit(">")).alias("author")).agg(F.count(F.lit(1)).alias("n_commits"))
    whole = F.sum("n_commits").over(Window.partitionBy("item"))
    return counts.withColumn("share", F.round(F.col("n_commits").cast("double") / whole * F.lit(100.0), 6))


def last_commit(items: DataFrame, commits: DataFrame) -> DataFrame:
    """The commit of the greatest date string of each item; of equal dates the greatest id."""
    rows = items.join(commits.select(F.col("id").alias("commit_id"), "authored_date", "author_name"), "commit_id")
    best = F.max_by(F.struct("commit_id", "author_name", "authored_date"), F.struct("authored_date", "commit_id"))
    return rows.groupBy("item").agg(best.alias("b")).select("item", "b.*")


def cochange(items: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of items in the same commits: how often, and how often for each commit of the first, in per cent.

    A self-join by commit, each pair once and turned round after it is counted; a commit gives as many pairs as the result has.
    It is a merge join, so that a commit that touches very much is split. For one item use ``cochange_of``, which makes no pairs.
    """
    left, right = items.withColumnRenamed("item", "a"), items.withColumnRenamed("item", "b")
    pairs = left.join(right.hint("merge"), "commit_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_together")).filter(F.col("n_together") >= least)
    pairs = pairs.select(F.explode(F.array(F.struct("a", "b", "n_together"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n_together"))).alias("p")).select("p.*")
    rate = F.round(F.col("n_together").cast("double") / F.col("churn").cast("double") * F.lit(100.0), 6)
    return pairs.join(churn(items).withColumnRenamed("item", "a"), "a").select("a", "b", "n_together", rate.alias("rate"))


def cochange_of(items: DataFrame, item) -> DataFrame:
    """What changes together with one item, how often, and the share of the item's commits: linear in the items of its commits."""
    own = items.filter(F.col("item") == item).select("commit_id")
    n = own.agg(F.count(F.lit(1)).alias("churn"))  # one row
    beside = items.join(own, "commit_id", "left_semi").filter(F.col("item") != item).groupBy(F.col("item").alias("b")).agg(F.count(F.lit(1)).alias("n_together"))
    rate = F.round(F.col("n_together").cast("double") / F.col("churn").cast("double") * F.lit(100.0), 6)
    return beside.crossJoin(F.broadcast(n)).select(F.lit(item).alias("a"), "b", "n_together", rate.alias("rate"))


def git_metadata(items: DataFrame, commits: DataFrame) -> DataFrame:
    """Churn, last commit and authors in order of frequency, one row an item."""
    authors = author_frequency(items, commits).groupBy("item").agg(F.sort_array(F.collect_list(F.struct((-F.col("n_commits")).alias("o"), "author")), True).alias("authors"))
    authors = authors.select("item", F.transform("authors", lambda x: x["author"]).alias("authors"))
    return churn(items).join(last_commit(items, commits), "item").join(authors, "item")
