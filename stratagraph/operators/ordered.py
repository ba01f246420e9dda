"""Running sums over a global order and exact percentiles, without windows or maps over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.session import durable


def running_sum(df: DataFrame, order: str, value: str, name: str, total: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over rows with a smaller ``order``, and ``total``: the sum over all.

    Rows are range-partitioned by ``order``, whose values must be distinct. Sums of whole partitions, one
    row each, are accumulated and joined to the sums within each partition.
    """
    spread = durable(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    within = W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    parts = spread.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({"__ahead": F.coalesce(F.sum("__sum").over(before), F.lit(0)), total: F.sum("__sum").over(W.partitionBy())})
    joined = spread.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(parts.drop("__sum")), "__part")
    return joined.withColumn(name, F.col("__ahead") + F.col("__own")).drop("__part", "__ahead", "__own")


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], steps: int = 64) -> DataFrame:
    """``by`` and the nearest-rank percentiles of ``value`` per group, exact; groups without a value are left out, null keys are a group.

    Rows become counts per distinct value, counts become sums per range of values (``steps`` ranges per
    power of e, so their number doesn't grow with the rows), and only the values of the one range that
    holds a rank are ordered. No task sees all rows or all values of a hot group.
    """
    names = list(shares)
    band = F.floor(F.signum("__v") * F.log1p(F.abs("__v")) * steps)
    # Keys are compared as one struct, in which null equals null.
    counts = durable(df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.struct(*by).alias("__k"), F.col(value).cast("double").alias("__v")).groupBy("__k", "__v").agg(F.count("*").alias("__n")).withColumn("__band", band))
    bands = counts.groupBy("__k", "__band").agg(F.sum("__n").alias("__in"))
    upto = W.partitionBy("__k").orderBy("__band").rowsBetween(W.unboundedPreceding, W.currentRow)
    bands = bands.withColumns({"__upto": F.sum("__in").over(upto), "__all": F.sum("__in").over(W.partitionBy("__k"))})
    # A share's rank as a whole number; products such as 0.95 * 100 may lie just above it.
    ranks = F.array(*(F.struct(F.lit(n).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("__all") - 1e-9)).alias("rank")) for n, s in shares.items()))
    wanted = bands.select("__k", "__band", (F.col("__upto") - F.col("__in")).alias("__before"), "__upto", F.inline(ranks)).where("rank > __before and rank <= __upto")
    inside = W.partitionBy("__k", "__band", "name").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    wanted = wanted.withColumnsRenamed({"__k": "__wk", "__band": "__wb"})
    placed = counts.join(wanted, F.col("__k").eqNullSafe(F.col("__wk")) & (F.col("__band") == F.col("__wb")))
    placed = placed.withColumn("__at", F.col("__before") + F.sum("__n").over(inside)).where("__at >= rank")
    return placed.groupBy("__k").agg(*(F.min(F.when(F.col("name") == n, F.col("__v"))).alias(n) for n in names)).select("__k.*", *names)


def with_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], others: dict) -> DataFrame:
    """``by``, the aggregates ``others`` (name to column) and exact percentiles of ``value`` side by side; groups without a value have null ones."""
    sums = df.groupBy(*by).agg(*(c.alias(n) for n, c in others.items()))
    found = exact_percentiles(df, by, value, shares).toDF(*(f"__{c}" for c in by), *shares)
    same = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = one if same is None else same & one
    return sums.join(found, same, "left").drop(*(f"__{c}" for c in by))
