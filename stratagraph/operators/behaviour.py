"""What changed in the behaviour of a system between two sets of flows, and how flows go on in each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import graph
from stratagraph.session import durable


def flow_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """``key``, change and what: flows added, removed or changed, and entries that lost or lack a guard.

    Both sides have the ``key`` columns and arrays ``guards`` and ``entities`` (sorted, without repetition). A
    flow that lost all guards has 'lost guard'; a new one without guards has 'new unguarded' if at
    least half of all flows after it are guarded. ``what`` lists what the change consists of.
    """
    old, new = before.select(*key, F.col("guards").alias("g0"), F.col("entities").alias("e0"), F.lit(True).alias("was")), after.select(*key, F.col("guards").alias("g1"), F.col("entities").alias("e1"), F.lit(True).alias("is"))
    norm = after.agg(((F.count_if(F.size("guards") > 0) * 2 >= F.count("*")) & (F.count_if(F.size("guards") > 0) >= 1)).alias("norm"))
    both = old.join(new, key, "full").join(F.broadcast(norm))  # one row
    said = lambda label, items: F.transform(items, lambda x: F.concat(F.lit(label), x))
    lost = (F.size("g0") > 0) & (F.size("g1") == 0)
    changes = F.flatten(F.array(
        F.when(lost, F.array(F.lit("lost guard"))).otherwise(said("removed guard ", F.array_except("g0", "g1"))),
        said("gained guard ", F.array_except("g1", "g0")), said("new entity ", F.array_except("e1", "e0")), said("removed entity ", F.array_except("e0", "e1")),
    ))
    nothing = F.array().cast("array<string>")
    change = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.size("what") > 0, "changed")
    what = F.when(F.col("is").isNull(), nothing).when(F.col("was").isNull(), F.when((F.size("g1") == 0) & F.coalesce("norm", F.lit(False)), F.array(F.lit("new unguarded"))).otherwise(nothing)).otherwise(changes)
    return both.withColumn("what", F.array_sort(what)).withColumn("change", change).where("change is not null").select(*key, "change", "what")


def journeys(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, depth) of the flows that each journey passes: all that its start leads to, each once.

    A start that another start leads to is no journey of its own, unless both lead to each other.
    ``links`` has source and target, ``starts`` id.
    """
    reached = durable(graph.reach_per_seed(durable(links), starts).withColumnRenamed("seed", "start"))
    inner = reached.where("depth > 0").join(starts, "id", "left_semi").select(F.col("id").alias("start")).distinct()
    return reached.join(inner, "start", "left_anti")


def resolved(references: DataFrame, units: DataFrame) -> DataFrame:
    """References (ref, project_id, file, name) with the unit (id, project_id, file, name) each names: ref, id and via.

    In this order: a unit of that name in the same file, one in the same project if no other there has the
    name, and one anywhere if its name is unique at all. Several units of the name in one file leave it open.
    """
    one = lambda keys, name: units.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    tried = references
    for keys, name in ((["project_id", "file", "name"], "by_file"), (["project_id", "name"], "by_project"), (["name"], "by_name")):
        tried = tried.join(one(keys, name), keys, "left")
    via = F.when(F.col("by_file").isNotNull(), "file").when(F.col("by_project").isNotNull(), "project").when(F.col("by_name").isNotNull(), "name")
    return tried.select("ref", F.coalesce("by_file", "by_project", "by_name").alias("id"), via.alias("via"))
