"""Change history: churn, co-change and hot spots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_churn(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: commits, authors, fixes, commits of the last 30 and 90 days before the newest commit, added and removed lines."""
    head = commits.agg(F.max("ts")).scalar()
    joined = files.join(commits, "commit_id")
    since = lambda days: F.count_if(F.col("ts") >= head - F.make_dt_interval(F.lit(days)))
    return joined.groupBy("path").agg(F.count("*").alias("commits"), F.count_distinct("author").alias("authors"), F.count_if(F.col("intent") == "1-URGENT").alias("fixes"), since(30).alias("last_30d"), since(90).alias("last_90d"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def co_change(files: DataFrame, least_files: int = 2, most_files: int = 50, support: int = 2) -> DataFrame:
    """Unordered pairs of files that changed together in at least ``support`` commits: a, b, together.

    Only commits of 2 to ``most_files`` files count (the feature), which also bounds the pairs of one
    commit; they are made inside the commit's row, without a self-join.
    """
    sized = files.groupBy("commit_id").agg(F.count_distinct("path").alias("n")).where(F.col("n").between(least_files, most_files))
    bundles = files.join(sized, "commit_id").groupBy("commit_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    pairs = F.flatten(F.transform("paths", lambda a, i: F.transform(F.slice("paths", i + 2, F.size("paths")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return bundles.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("together")).where(F.col("together") >= support)


def co_change_index(files: DataFrame, support: int = 2) -> DataFrame:
    """Partners of each file: path, partner, support, probability and lift."""
    pairs = co_change(files, support=support)
    alone = files.groupBy("path").agg(F.count_distinct("commit_id").alias("n"))
    total = files.agg(F.count_distinct("commit_id")).scalar()
    both = pairs.select(F.col("a").alias("path"), F.col("b").alias("partner"), "together").unionByName(pairs.select(F.col("b").alias("path"), F.col("a").alias("partner"), "together"))
    joined = both.join(alone, "path").join(alone.select(F.col("path").alias("partner"), F.col("n").alias("m")), "partner")
    return joined.select("path", "partner", F.col("together").alias("support"), F.round(F.col("together") / F.col("n"), 6).alias("probability"), F.round(F.col("together") * total / (F.col("n") * F.col("m")), 6).alias("lift"))
