"""Queries of the core problems 2, 4 and 7 and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.catalog import Catalog
from stratagraph.operators import shredding, skew, snapshots


def _q(build):
    return lambda spark, root: build(Catalog(spark, root))


def _found_steps(t: Catalog):
    steps = shredding.flow_steps(t("entry_point_flow")).where("node_id is not null and node_id != ''")
    return steps.select(F.col("record").alias("record_id"), "step_path", "parent_node_id", "node_id").distinct()


def _flow_steps(t: Catalog):
    steps = shredding.flow_steps(t("entry_point_flow"), {"name": "name", "layer": "layer", "depth": "depth"})
    return steps.select(F.col("record").alias("record_id"), "step_path", "parent_node_id", "node_id", "name", "layer", F.col("depth").cast("int").alias("depth")).distinct()


QUERIES = {
    "p2_found": _q(_found_steps),
    "p2_flows": _q(lambda t: shredding.flow_table(t("entry_point_flow"))),
    "p2_steps": _q(_flow_steps),
    "p2_effects": _q(lambda t: shredding.flow_effects(t("entry_point_flow")).drop("owner").distinct()),
    "p2_effect_owners": _q(lambda t: shredding.flow_effects(t("entry_point_flow"))),
    "p2_broken": _q(lambda t: shredding.broken_documents(t("entry_point_flow"))),
    "p2_sources": _q(lambda t: shredding.node_sources(t("cas_node"))),
    "p2_parameters": _q(lambda t: shredding.node_parameters(t("cas_node"))),
    "p4_found": _q(lambda t: snapshots.node_changes(t("cas_node"), t("analysis_entry")).select("id", "snapshot_no", "change").distinct()),
    "p4_changes": _q(lambda t: snapshots.node_changes(t("cas_node"), t("analysis_entry"))),
    "p7_found": _q(lambda t: skew.heavy_targets(t("cas_edge"), t("shared_node")).select("target")),
    "p7_named_callers": _q(lambda t: skew.named_callers(t("cas_edge"), t("shared_node"))),
    "p7_callers": _q(lambda t: skew.callers_of_target(t("cas_edge"))),
    "p7_library_edges": _q(lambda t: skew.eager_join_counts(t("cas_edge"), t("shared_node").withColumnRenamed("id", "target"), "target", {"occurrences": "occurrences"}, ["library"])),
}



def _open(x: str) -> str:
    """SQL of a JSON value in which a string that holds an object or a list stands for these."""
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' AND left(ltrim({x}->>'$'), 1) IN ('{{', '[') AND json_valid({x}->>'$') THEN CAST({x}->>'$' AS JSON) ELSE {x} END)"


def _items(x: str, lone: str) -> str:
    """SQL of the items of a list, of an object with numbers as keys, or, if asked for, of a lone object."""
    numbered = f"len(json_keys({x})) > 0 AND len(list_filter(json_keys({x}), lambda k: NOT regexp_full_match(k, '[0-9]+'))) = 0"
    ordered = f"""list_transform(list_sort(list_transform(json_keys({x}), lambda k: {{'n': CAST(k AS HUGEINT), 'k': k}})), lambda s: json_extract({x}, '$."' || s.k || '"'))"""
    return f"(CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN CASE WHEN {numbered} THEN {ordered} ELSE {lone} END ELSE [] END)"


_FLOWS = f"""
WITH RECURSIVE docs AS (SELECT DISTINCT record_id, CAST(payload AS JSON) AS p FROM entry_point_flow WHERE payload IS NOT NULL AND json_valid(payload)),
roots AS (SELECT record_id, d FROM (SELECT record_id, {_open('p')} AS d FROM docs) WHERE json_type(d) = 'OBJECT'),
entries AS (SELECT record_id, d, {_open("json_extract(d, '$.entry')")} AS e FROM roots),
heads AS (SELECT record_id, d, coalesce(e->>'handler_node_id', {_open("json_extract(e, '$.handler')")}->>'node_id', '') AS handler FROM entries),
top AS (SELECT record_id, handler, {_items('x', '[x]')} AS l FROM (SELECT record_id, handler, {_open("json_extract(d, '$.steps')")} AS x FROM heads)),
walk(record_id, step_path, parent_node_id, o) AS (
  SELECT record_id, CAST(i - 1 AS VARCHAR), handler, {_open('s')} FROM (SELECT record_id, handler, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM top)
  UNION ALL
  SELECT record_id, step_path || '.' || (i - 1), parent, {_open('s')} FROM (SELECT record_id, step_path, parent, unnest(l) AS s, generate_subscripts(l, 1) AS i
    FROM (SELECT record_id, step_path, coalesce(o->>'node_id', '') AS parent, {_items('x', '[x]')} AS l
      FROM (SELECT record_id, step_path, o, {_open("json_extract(o, '$.steps')")} AS x FROM walk WHERE json_type(o) = 'OBJECT')))),
steps AS (SELECT DISTINCT record_id, step_path, parent_node_id, o->>'node_id' AS node_id, o->>'name' AS name, o->>'layer' AS layer, CAST(o->>'depth' AS INTEGER) AS depth FROM walk WHERE json_type(o) = 'OBJECT'),
lists AS (SELECT record_id, effect, {_open("json_extract(e, '$.' || effect)")} AS x
  FROM (SELECT record_id, {_open("json_extract(d, '$.terminal_effects')")} AS e FROM roots), (SELECT unnest(['entities_written', 'entities_read', 'external_services', 'messages_emitted']) AS effect)),
effects AS (SELECT DISTINCT record_id, effect, CAST(i - 1 AS INTEGER) AS position, v->>'$' AS entity
  FROM (SELECT record_id, effect, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT record_id, effect, {_items('x', '[]')} AS l FROM lists)) WHERE json_type(v) <> 'NULL')
"""
_CHANGES = """
WITH cur AS (
  SELECT project_id, snapshot_no, id, name, type, qualified_name, category, level,
         trim(coalesce(description, ''), E' \\t\\n\\r\\f\\v\\u00a0\\u2003\\u2009\\u3000') AS description, source.file AS file
  FROM cas_node WHERE project_id IS NOT NULL AND snapshot_no IS NOT NULL AND id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY project_id, snapshot_no, id ORDER BY recorded_at DESC) = 1),
sizes AS (SELECT project_id, snapshot_no, count(*) AS n FROM cur GROUP BY ALL),
complete AS (SELECT s.project_id, s.snapshot_no, lag(s.snapshot_no) OVER (PARTITION BY s.project_id ORDER BY s.snapshot_no) AS before
  FROM sizes s WHERE EXISTS (SELECT 1 FROM analysis_entry e WHERE e.project_id = s.project_id AND e.snapshot_no = s.snapshot_no AND e.node_count = s.n)),
now AS (SELECT c.*, k.before FROM cur c JOIN complete k USING (project_id, snapshot_no) WHERE k.before IS NOT NULL),
past AS (SELECT c.* REPLACE (k.snapshot_no AS snapshot_no), k.before FROM cur c JOIN complete k ON c.project_id = k.project_id AND c.snapshot_no = k.before),
joined AS (SELECT coalesce(n.project_id, p.project_id) AS project_id, coalesce(n.snapshot_no, p.snapshot_no) AS snapshot_no,
    coalesce(n.before, p.before) AS before, coalesce(n.id, p.id) AS id,
    CASE WHEN p.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed'
         WHEN (n.name, n.type, n.qualified_name, n.category, n.level, n.description, n.file)
              IS DISTINCT FROM (p.name, p.type, p.qualified_name, p.category, p.level, p.description, p.file) THEN 'changed' END AS change
  FROM now n FULL JOIN past p ON n.project_id = p.project_id AND n.snapshot_no = p.snapshot_no AND n.id = p.id)
"""
_CALLERS = """
WITH callers AS (SELECT target,
    count(DISTINCT id) + count(*) FILTER (WHERE id IS NULL) AS edges,
    count(DISTINCT source) FILTER (WHERE source <> target) AS callers_of_target
  FROM cas_edge WHERE target IS NOT NULL GROUP BY target)
"""

#: Handlers of flow entries, for other modules.
HANDLERS_SQL = _FLOWS + "SELECT DISTINCT handler AS id FROM heads WHERE handler <> ''"

SQL = {
    "p2_found": _FLOWS + "SELECT DISTINCT record_id, step_path, parent_node_id, node_id FROM steps WHERE coalesce(node_id, '') <> ''",
    "p2_steps": _FLOWS + "SELECT * FROM steps",
    "p2_flows": _FLOWS + "SELECT DISTINCT record_id, d->>'id' AS flow_id, d->>'name' AS name, d->>'flow_kind' AS flow_kind, d->>'entry_point_id' AS entry_point_id, d->>'criticality' AS criticality FROM roots",
    "p2_effects": _FLOWS + "SELECT * FROM effects",
    "p2_broken": "SELECT DISTINCT record_id FROM entry_point_flow WHERE payload IS NOT NULL AND NOT json_valid(payload)",
    "p2_sources": "SELECT DISTINCT analysis_id, id AS node_id, source.file AS file, source.line AS line, source.end_line AS end_line FROM cas_node WHERE source IS NOT NULL",
    "p2_parameters": """SELECT DISTINCT analysis_id, node_id, CAST(i - 1 AS INTEGER) AS position, p.name AS name, p.type AS type, p.optional AS optional
        FROM (SELECT analysis_id, id AS node_id, unnest(signature.parameters) AS p, generate_subscripts(signature.parameters, 1) AS i FROM cas_node)""",
    "p4_found": _CHANGES + "SELECT DISTINCT id, snapshot_no, change FROM joined WHERE change IS NOT NULL",
    "p4_changes": _CHANGES + "SELECT project_id, snapshot_no, before, id, change FROM joined WHERE change IS NOT NULL",
    "p7_found": _CALLERS + "SELECT target FROM callers WHERE callers_of_target > 0 AND callers_of_target * 100 >= (SELECT sum(callers_of_target) FROM callers)",
    "p7_named_callers": _CALLERS + "SELECT target, library, edges, callers_of_target FROM callers LEFT JOIN (SELECT id AS target, min(library) AS library FROM shared_node GROUP BY 1) USING (target)",
    "p7_callers": _CALLERS + "SELECT target, edges, callers_of_target FROM callers",
    "p7_library_edges": "SELECT s.library, count(*) AS joined_rows, CAST(sum(e.occurrences) AS BIGINT) AS occurrences FROM cas_edge e JOIN shared_node s ON e.target = s.id GROUP BY s.library",
}
