"""Questions about who reaches whom, over the condensation of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import graph
from stratagraph.session import durable


def can_reach(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (source, target) with reaches: whether a way of edges leads from source to target.

    A node reaches itself, known or not. All sources asked for walk together, each over every node once,
    and a way that found all its targets isn't followed further.
    """
    wanted = durable(asked.select("source", "target").where("source <> target").distinct())
    frontier = seen = durable(wanted.select(F.col("source").alias("seed"), F.col("source").alias("id")).distinct())
    found, level = None, 0
    while True:
        level += 1
        step = frontier.select("seed", F.col("id").alias("source")).join(pairs, "source").select("seed", F.col("target").alias("id")).distinct()
        new = durable(step.join(seen, ["seed", "id"], "left_anti"))
        if new.isEmpty():
            break
        hit = new.join(wanted.withColumnsRenamed({"source": "seed", "target": "id"}), ["seed", "id"], "left_semi")
        found = hit if found is None else found.unionByName(hit)
        # Seeds with all targets found are done.
        open_seeds = wanted.withColumnsRenamed({"source": "seed", "target": "id"}).join(found, ["seed", "id"], "left_anti").select("seed").distinct()
        frontier, seen = new.join(open_seeds, "seed", "left_semi"), seen.unionByName(new)
        if level % graph.MERGED == 0:
            seen, found, frontier = durable(seen), durable(found), durable(frontier)
    reached = asked.select("source", "target").distinct()
    if found is None:
        return reached.withColumn("reaches", F.col("source") == F.col("target"))
    hits = found.withColumnsRenamed({"seed": "source", "id": "target"}).withColumn("hit", F.lit(True))
    return reached.join(hits, ["source", "target"], "left").select("source", "target", (F.coalesce("hit", F.lit(False)) | (F.col("source") == F.col("target"))).alias("reaches"))


def condensed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, component) and the distinct (source, target) between different strong components."""
    strong = durable(graph.strong_components(pairs))
    named = pairs.join(strong.withColumnsRenamed({"id": "source", "component": "a"}), "source").join(strong.withColumnsRenamed({"id": "target", "component": "b"}), "target")
    return strong, durable(named.where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct())


def affected_components(pairs: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """id, component and level of what leads to the seeds, level by level of strong components, whole components only.

    The seeds' own components are level 0; seeds themselves are left out.
    """
    strong, steps = condensed(pairs)
    start = strong.join(seeds.select("id"), "id", "left_semi").select(F.col("component").alias("id")).distinct()
    levels = graph.reach(graph.turned(steps), start, depth).select(F.col("id").alias("component"), F.col("depth").alias("level"))
    return strong.join(levels, "component").join(seeds.select("id"), "id", "left_anti").select("id", "component", "level")


def bounded_walk(pairs: DataFrame, seeds: DataFrame, depth: int, most: int) -> DataFrame:
    """The first ``most`` nodes of a walk, by depth and id, and whether there were more: id, depth, truncated. The bound is the feature."""
    reached = graph.reach(pairs, seeds, depth).select("id", "depth")
    count = reached.agg(F.count("*")).scalar()
    return reached.orderBy("depth", "id").limit(most).withColumn("truncated", count > most)
