"""Flat views of flow payloads and their SQL twins: flows, their steps, boundaries and effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.catalog import Catalog
from stratagraph.functions import text as fx
from stratagraph.operators import shredding
from stratagraph.queries.nested import _FLOWS, _items, _open
from stratagraph.session import durable

SCALARS = "id name flow_kind entry_point_id criticality type method path_or_trigger handler_node_id node_id layer depth mechanism".split()


def tables(t: Catalog) -> dict[str, DataFrame]:
    """flows, steps, boundaries and effects of all complete payloads, from one adjacency table that is written once."""
    records = t("entry_point_flow")
    adjacency = durable(shredding.flow_adjacency(records, {*SCALARS, *shredding.EFFECTS}))
    objects = durable(shredding.pivot_objects(adjacency, {n: n for n in SCALARS}))
    lone = F.col("list_label").isNull()
    roots = objects.where("owner is null and label is null").select(F.col("record").alias("record_id"), "doc", F.col("id").alias("flow_id"), "name", "flow_kind", "entry_point_id", "criticality")
    entries = objects.where(lone & (F.col("label") == "entry") & (F.col("owner") == 0)).select(F.col("record").alias("record_id"), "doc", F.col("type").alias("entry_type"), "method", F.col("path_or_trigger").alias("trigger"), F.col("handler_node_id").alias("own_handler"))
    handlers = objects.where(lone & (F.col("label") == "handler")).groupBy(F.col("record").alias("record_id"), "doc").agg(F.max("node_id").alias("handler"))
    projects = records.select("record_id", "project_id").distinct()
    flows = roots.join(entries, ["record_id", "doc"], "left").join(handlers, ["record_id", "doc"], "left").join(projects, "record_id").withColumn("handler", F.coalesce("own_handler", "handler")).drop("own_handler", "doc").distinct()
    steps = shredding.steps_of(adjacency, {"name": "name", "layer": "layer"}).select(F.col("record").alias("record_id"), "step_path", "parent_node_id", "node_id", "name", "layer").distinct()
    boundaries = objects.where("list_label = 'security_boundaries'").select(F.col("record").alias("record_id"), "name", "mechanism").where("name is not null").distinct()
    return {"flows": flows, "steps": steps, "boundaries": boundaries, "effects": shredding.effects_of(adjacency).drop("owner").distinct()}


def links(steps: DataFrame, flows: DataFrame) -> DataFrame:
    """(source, target): flows that go on in another one, whose handler is one of their steps."""
    starts = flows.where("handler is not null").select(F.col("handler").alias("node_id"), F.col("record_id").alias("target")).distinct()
    return steps.where("node_id is not null").select(F.col("record_id").alias("source"), "node_id").distinct().join(starts, "node_id").where("source <> target").select("source", "target").distinct()


def by_route(flows: DataFrame) -> DataFrame:
    """record_id, project_id and normal route of the flows that a path triggers."""
    return flows.where("trigger like '/%'").select("record_id", "project_id", fx.normal_route(F.col("trigger")).alias("route"))


_BOUNDS = f"""
bounds AS (SELECT DISTINCT record_id, o->>'name' AS name, o->>'mechanism' AS mechanism
  FROM (SELECT record_id, {_open('b')} AS o FROM (SELECT record_id, unnest(l) AS b FROM (SELECT record_id, {_items('x', '[]')} AS l FROM (SELECT record_id, {_open("json_extract(d, '$.security_boundaries')")} AS x FROM roots))))
  WHERE json_type(o) = 'OBJECT' AND o->>'name' IS NOT NULL)"""
#: Named subqueries flows, steps, bounds, effects and links, to be followed by ', ...' or a SELECT.
FLOW_SQL = f"""{_FLOWS.rstrip()},{_BOUNDS},
flows AS (SELECT DISTINCT r.record_id, r.d->>'id' AS flow_id, r.d->>'name' AS name, r.d->>'flow_kind' AS flow_kind, r.d->>'entry_point_id' AS entry_point_id, r.d->>'criticality' AS criticality,
    e.e->>'type' AS entry_type, e.e->>'method' AS method, e.e->>'path_or_trigger' AS trigger, nullif(h.handler, '') AS handler, p.project_id
  FROM roots r JOIN entries e USING (record_id) JOIN heads h USING (record_id) JOIN (SELECT DISTINCT record_id, project_id FROM entry_point_flow) p USING (record_id)),
links AS (SELECT DISTINCT s.record_id AS source, f.record_id AS target FROM steps s JOIN flows f ON f.handler = s.node_id WHERE s.record_id <> f.record_id)"""
