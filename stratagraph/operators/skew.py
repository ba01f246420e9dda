"""Per-key results over a few hot keys, by eager aggregation and by pair-wise distinct counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def caller_pairs(edges: DataFrame) -> DataFrame:
    """Compact states of edges by (target, source): target, source, edges and caller (1 or 0).

    An edge id counts once however often its row is repeated, a null id counts per row; self loops count
    as edges but not as callers, null targets are left out and null sources are no callers. A repeated
    row meets its twin in its (target, source) group, and a hot target is split over all its sources.
    """
    pairs = edges.where("target is not null").select("id", "source", "target").groupBy("target", "source").agg((F.count_distinct("id") + F.count_if(F.col("id").isNull())).alias("edges"))
    caller = F.coalesce(F.col("source") != F.col("target"), F.lit(False)).cast("long")
    return pairs.withColumn("caller", caller)


def callers_of_target(edges: DataFrame) -> DataFrame:
    """Edges and distinct callers of each target: target, edges, callers_of_target.

    The first aggregation is by (target, source), the second adds compact states that were already
    combined map-side, so no task sees a hot target's rows.
    """
    return caller_pairs(edges).groupBy("target").agg(F.sum("edges").alias("edges"), F.sum("caller").alias("callers_of_target"))


def eager_join_counts(left: DataFrame, right: DataFrame, on: str, left_sums: dict[str, str], roll_up: list[str], how: str = "inner") -> DataFrame:
    """Counts and sums of the join of two tables by ``roll_up`` columns (the key or the right's), without joining rows.

    Both sides are aggregated by the join key (the right also by the roll-up columns), the compact
    states are joined, counts are multiplied, sums of the left are multiplied by the right's count,
    and the products are rolled up. Null keys join nothing. ``left_sums`` maps result to left column.
    With ``how`` = 'left' keys that the right lacks count once, with null in its columns.
    """
    states = left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_ln"), *(F.sum(c).alias(f"_s_{n}") for n, c in left_sums.items()))
    counts = right.where(F.col(on).isNotNull()).groupBy(on, *(c for c in roll_up if c != on)).agg(F.count("*").alias("_rn"))
    joined = states.join(counts, on, how).withColumn("_rn", F.coalesce("_rn", F.lit(1)))
    return joined.groupBy(*roll_up).agg(F.sum(F.col("_ln") * F.col("_rn")).alias("joined_rows"), *(F.sum(F.col(f"_s_{n}") * F.col("_rn")).alias(n) for n in left_sums))


def named_callers(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Callers of targets beside what is known of the target: target, library, edges, callers_of_target.

    The edges' states by (target, source) are joined with shared units (id, library) by ``eager_join_counts``;
    a target that is no shared unit has a null library. A unit given several times counts once.
    """
    names = units.groupBy(F.col("id").alias("target")).agg(F.min("library").alias("library"))
    return eager_join_counts(caller_pairs(edges), names, "target", {"edges": "edges", "callers_of_target": "caller"}, ["target", "library"], "left").drop("joined_rows")


def heavy_targets(edges: DataFrame, units: DataFrame, percent: int = 1) -> DataFrame:
    """Targets holding at least ``percent`` percent of all callers: target, library, edges, callers_of_target.

    The total is a scalar subquery over the rolled-up states; the comparison is in whole numbers. No callers at all gives no rows.
    """
    counts = named_callers(edges, units)
    total = counts.agg(F.sum("callers_of_target")).scalar()
    return counts.where((F.col("callers_of_target") > 0) & (F.col("callers_of_target") * 100 >= total * percent))
