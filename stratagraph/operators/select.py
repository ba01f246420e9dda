"""Look-ups, filters, paging and ranking windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """Rows in a total order, from ``offset`` on; the order must end in a unique key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_more(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows and in ``truncated`` whether more exist: one row more is taken and only counted."""
    taken = df.orderBy(*order).limit(limit + 1).withColumn("__n", F.row_number().over(W.orderBy(*order)))
    return taken.withColumn("truncated", F.max("__n").over(W.partitionBy()) > limit).where(F.col("__n") <= limit).drop("__n")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; the limit applies before the shuffle too."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def percentile_below(df: DataFrame, value: str, name: str = "percentile") -> DataFrame:
    """floor(100 * share of rows strictly below), from counts per distinct value: the rows are not sorted in one task.

    The running sum goes over distinct values in range partitions: sums of the partitions are added to
    sums within them.
    """
    from stratagraph.operators.ordered import running_sum

    counts = df.groupBy(value).agg(F.count("*").alias("__n"))
    ranked = running_sum(counts, value, "__n", "__below", "__all")
    share = F.floor(F.lit(100) * F.col("__below") / F.col("__all")).cast("int")
    return df.join(ranked.select(value, share.alias(name)), value)


def breakdown(df: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    """Rows per value, null as ``unknown``."""
    return df.groupBy(F.coalesce(F.col(column), F.lit(unknown)).alias(column)).agg(F.count("*").alias("n"))


def neighbourhood(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their numbers of incoming and outgoing edges and distinct partners."""
    inn = edges.where("target is not null").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("edges_in"), F.count_distinct("source").alias("sources"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("edges_out"), F.count_distinct("target").alias("targets"))
    joined = nodes.join(inn, "id", "left").join(out, "id", "left")
    return joined.na.fill(0, ["edges_in", "sources", "edges_out", "targets"])
