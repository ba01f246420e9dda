"""Queries over flows, journeys and behaviour, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.functions import text as fx
from stratagraph.operators import behaviour, select
from stratagraph.plans import flows as fl
from stratagraph.plans import views as v
from stratagraph.plans.views import SQL_VIEWS
from stratagraph.queries.registry import Registry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
add = _r.add


def fsql(body: str, *names: str) -> str:
    """SQL after the named subqueries of flows and of other views."""
    views = "".join(f",\n{n} AS ({SQL_VIEWS[n]})" for n in names)
    return f"{fl.FLOW_SQL}{views}{', ' + body.strip()[5:] if body.strip()[:5].upper() == 'WITH ' else body}"


def _with(t, build):
    return build(fl.tables(t))


# -- flows as they are -----------------------------------------------------------
add(
    "workflows",
    lambda t: _with(t, lambda x: x["flows"].join(x["steps"].groupBy("record_id").agg(F.count("*").alias("steps")), "record_id", "left").select("record_id", "flow_id", "name", "flow_kind", F.coalesce("steps", F.lit(0)).alias("steps"))),
    fsql(" SELECT record_id, flow_id, f.name, flow_kind, coalesce(n, 0) AS steps FROM flows f LEFT JOIN (SELECT record_id, count(*) AS n FROM steps GROUP BY 1) USING (record_id)"),
)


def _chains(x):
    """Call chains: the way from the handler to each last step, as its node ids."""
    s = x["steps"]
    deep = s.where("instr(step_path, '.') > 0").select("record_id", F.regexp_replace("step_path", r"\.[0-9]+$", "").alias("step_path")).distinct()
    last = s.join(deep, ["record_id", "step_path"], "left_anti")
    parts = F.split("step_path", r"\.")
    above = last.select("record_id", F.col("step_path").alias("leaf"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, F.lit(1), i)))).alias("step_path"))
    way = above.join(s.select("record_id", "step_path", "node_id"), ["record_id", "step_path"])
    listed = way.groupBy("record_id", "leaf").agg(F.count("*").alias("length"), F.transform(F.array_sort(F.collect_list(F.struct(F.length("step_path").alias("n"), "step_path", "node_id"))), lambda p: F.coalesce(p["node_id"], F.lit("?"))).alias("nodes"))
    return listed.select("record_id", "leaf", "length", F.concat_ws(" > ", "nodes").alias("path"))


add(
    "call_chains",
    lambda t: _with(t, _chains),
    fsql("""WITH last AS (SELECT record_id, step_path AS leaf FROM steps s WHERE NOT EXISTS (SELECT 1 FROM steps c WHERE c.record_id = s.record_id AND starts_with(c.step_path, s.step_path || '.')))
    SELECT l.record_id, leaf, count(*) AS length, string_agg(coalesce(node_id, '?'), ' > ' ORDER BY len(step_path), step_path) AS path FROM last l JOIN steps s ON s.record_id = l.record_id AND (s.step_path = leaf OR starts_with(leaf, s.step_path || '.')) GROUP BY 1, 2"""),
)
add(
    "flow_layers",
    lambda t: _with(t, lambda x: x["steps"].where("layer is not null").groupBy("record_id", "layer").agg(F.min("step_path").alias("first")).groupBy("record_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("first", "layer"))), lambda p: p["layer"])).alias("layers"))),
    fsql(" SELECT record_id, string_agg(layer, ',' ORDER BY first, layer) AS layers FROM (SELECT record_id, layer, min(step_path) AS first FROM steps WHERE layer IS NOT NULL GROUP BY 1, 2) GROUP BY 1"),
)


def _ranking(x):
    """Flows by their score: fixed weights 3 per written entity, 2 per guard, 1 per step, 10 for critical ones."""
    size = lambda df, name: df.groupBy("record_id").agg(F.count("*").alias(name))
    joined = x["flows"].select("record_id", "flow_id", "criticality")
    for df, name in ((x["steps"], "steps"), (x["boundaries"], "guards"), (x["effects"].where("effect = 'entities_written'").select("record_id", "entity").distinct(), "written")):
        joined = joined.join(size(df, name), "record_id", "left")
    score = F.coalesce("written", F.lit(0)) * 3 + F.coalesce("guards", F.lit(0)) * 2 + F.coalesce("steps", F.lit(0)) + F.when(F.col("criticality") == "critical", 10).otherwise(0)
    return joined.select("record_id", "flow_id", score.alias("score"))


_RANKED = """ranked AS (SELECT record_id, flow_id, coalesce(w.n, 0) * 3 + coalesce(g.n, 0) * 2 + coalesce(s.n, 0) + CASE WHEN criticality = 'critical' THEN 10 ELSE 0 END AS score FROM flows
    LEFT JOIN (SELECT record_id, count(*) AS n FROM steps GROUP BY 1) s USING (record_id) LEFT JOIN (SELECT record_id, count(*) AS n FROM bounds GROUP BY 1) g USING (record_id)
    LEFT JOIN (SELECT record_id, count(DISTINCT entity) AS n FROM effects WHERE effect = 'entities_written' GROUP BY 1) w USING (record_id))"""
add("flow_ranking", lambda t: _with(t, _ranking), fsql(f"WITH {_RANKED} SELECT * FROM ranked"))
add("flow_concepts_page", lambda t: select.page(_with(t, _ranking), [F.col("score").desc(), "flow_id", "record_id"], 50), fsql(f"WITH {_RANKED} SELECT * FROM ranked ORDER BY score DESC, flow_id, record_id LIMIT 50"))


def _confidence(x):
    """Fixed weights: a fifth each for resolution, completeness, standing, mass (half at 8 units) and story (full at 4 steps)."""
    s = x["steps"].groupBy("record_id").agg(F.count("*").alias("steps"), F.count_if(F.col("node_id").isNull()).alias("open"), F.count_distinct("node_id").alias("units"))
    effects = x["effects"].groupBy("record_id").agg(F.max((F.col("effect") == "entities_written").cast("int")).alias("writes"))
    j = x["flows"].select("record_id").join(s, "record_id", "left").join(effects, "record_id", "left").na.fill(0, ["steps", "open", "units"])
    completeness = F.when(F.col("units") + F.col("open") == 0, 1.0).otherwise(1 - F.lit(0.5) * F.col("open") / (F.col("units") + F.col("open")))
    standing = F.when(F.col("writes") == 1, 1.0).when(F.col("writes") == 0, 0.55).otherwise(0.3)
    mass = F.least(F.lit(1.0), F.col("units") / (F.col("units") + 8.0) / (F.lit(40.0) / 48.0))
    return j.select("record_id", F.round(F.lit(0.2) * (1.0 + completeness + standing + mass + F.least(F.lit(1.0), F.col("steps") / 4.0)), 2).alias("confidence"))


add(
    "flow_confidence",
    lambda t: _with(t, _confidence),
    fsql("""WITH s AS (SELECT record_id, count(*) AS steps, count(*) FILTER (WHERE node_id IS NULL) AS open, count(DISTINCT node_id) AS units FROM steps GROUP BY 1), e AS (SELECT record_id, max(CASE WHEN effect = 'entities_written' THEN 1 ELSE 0 END) AS writes FROM effects GROUP BY 1),
    j AS (SELECT record_id, coalesce(steps, 0) AS steps, coalesce(open, 0) AS open, coalesce(units, 0) AS units, writes FROM (SELECT DISTINCT record_id FROM flows) LEFT JOIN s USING (record_id) LEFT JOIN e USING (record_id))
    SELECT record_id, round(0.2::DOUBLE * (1 + CASE WHEN units + open = 0 THEN 1 ELSE 1 - 0.5::DOUBLE * open / (units + open) END + CASE writes WHEN 1 THEN 1 WHEN 0 THEN 0.55::DOUBLE ELSE 0.3::DOUBLE END + least(1, units / (units + 8::DOUBLE) / (40::DOUBLE / 48)) + least(1, steps / 4::DOUBLE)), 2) AS confidence FROM j"""),
)


def _met(t):
    """Observations beside the flows whose trigger has their route's shape: record_id and the event's columns."""
    flows = fl.tables(t)["flows"].where("trigger like '/%'").select("record_id", "entry_point_id", "flow_kind", "criticality", fx.route_shape(F.col("trigger")).alias("shape"))
    o = v.observations(t).where("path like '/%'").select(fx.route_shape(F.col("path")).alias("shape"), "status", "recorded_at", "error_type", "feed")
    # Events of one shape become one state before they meet the flows.
    bad = F.coalesce(F.col("error_type").isNotNull() | (F.col("status") >= 500), F.lit(False))
    states = o.groupBy("shape").agg(F.count("*").alias("events"), F.count_if(bad).alias("failed"), F.max("recorded_at").alias("last_seen"), F.min("feed").alias("a"), F.max("feed").alias("z"))
    return flows, states


def _overlay(t):
    """Runtime figures beside all flows that a path triggers."""
    flows, states = _met(t)
    return flows.join(states, "shape", "left").select("record_id", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("failed", F.lit(0)).alias("failed"), "last_seen")


_SHAPE = r"'/' || array_to_string(list_transform(list_filter(string_split(regexp_replace({0}, '[?#].*', ''), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^(:|\{{|\[|\*|<|\$)') OR regexp_matches(s, '^[0-9]+$') THEN '{{}}' ELSE lower(s) END), '/')"
_MET = f"""f AS (SELECT record_id, entry_point_id, flow_kind, criticality, {_SHAPE.format('trigger')} AS shape FROM flows WHERE trigger LIKE '/%'),
    o AS (SELECT shape, count(*) AS events, count(*) FILTER (WHERE coalesce(error_type IS NOT NULL OR status >= 500, false)) AS failed, max(recorded_at) AS last_seen, min(feed) AS a, max(feed) AS z FROM (SELECT *, {_SHAPE.format('path')} AS shape FROM obs WHERE path LIKE '/%') GROUP BY 1)"""
add("flow_telemetry", _overlay, fsql(f"WITH {_MET} SELECT record_id, coalesce(events, 0) AS events, coalesce(failed, 0) AS failed, last_seen FROM f LEFT JOIN o USING (shape)", "obs"))


def _correlation(t):
    """Entry points with the events that their flows' routes were seen with."""
    flows, states = _met(t)
    return flows.where("entry_point_id is not null").select("entry_point_id", "shape").distinct().join(states, "shape").groupBy("entry_point_id").agg(F.sum("events").alias("events"), F.sum("failed").alias("failed"), F.max("last_seen").alias("last_seen"))


add("runtime_correlation", _correlation, fsql(f"WITH {_MET} SELECT entry_point_id, CAST(sum(events) AS BIGINT) AS events, CAST(sum(failed) AS BIGINT) AS failed, max(last_seen) AS last_seen FROM (SELECT DISTINCT entry_point_id, shape FROM f WHERE entry_point_id IS NOT NULL) JOIN o USING (shape) GROUP BY 1", "obs"))


def _capability(t):
    """Kinds of flows with the events of their routes: errors, latest event and feed ('mixed' for several)."""
    flows, states = _met(t)
    j = flows.select(F.coalesce("flow_kind", F.lit("none")).alias("capability"), "shape").distinct().join(states, "shape")
    return j.groupBy("capability").agg(F.sum("events").alias("requests"), F.round(F.sum("failed") / F.sum("events"), 6).alias("error_rate"), F.max("last_seen").alias("last_seen"), F.when(F.min("a") != F.max("z"), "mixed").otherwise(F.min("a")).alias("feed"))


add("capability_telemetry", _capability, fsql(f"WITH {_MET} SELECT capability, CAST(sum(events) AS BIGINT) AS requests, round(sum(failed) / sum(events)::DOUBLE, 6) AS error_rate, max(last_seen) AS last_seen, CASE WHEN min(a) <> max(z) THEN 'mixed' ELSE min(a) END AS feed FROM (SELECT DISTINCT coalesce(flow_kind, 'none') AS capability, shape FROM f) JOIN o USING (shape) GROUP BY 1", "obs"))


def _entity_flows(x):
    """Pairs of flows that write or read one entity, counted per entity; the entity is the capability."""
    touched = x["effects"].where("effect in ('entities_written', 'entities_read')").select("record_id", F.lower("entity").alias("capability"), (F.col("effect") == "entities_written").alias("writes")).groupBy("record_id", "capability").agg(F.max("writes").alias("writes"))
    return touched.groupBy("capability").agg(F.count("*").alias("flows"), F.count_if("writes").alias("writers"), F.count_if(~F.col("writes")).alias("readers"), (F.count_if("writes") * F.count_if(~F.col("writes"))).alias("links"))


_CAPS = "caps AS (SELECT lower(entity) AS capability, record_id, max(CASE WHEN effect = 'entities_written' THEN 1 ELSE 0 END) AS w FROM effects WHERE effect IN ('entities_written', 'entities_read') GROUP BY 1, 2)"
add("capability_flow_links", lambda t: _with(t, _entity_flows), fsql(f"WITH {_CAPS} SELECT capability, count(*) AS flows, count(*) FILTER (WHERE w = 1) AS writers, count(*) FILTER (WHERE w = 0) AS readers, count(*) FILTER (WHERE w = 1) * count(*) FILTER (WHERE w = 0) AS links FROM caps GROUP BY 1"))


def _flow_roles(x):
    """'core' for flows that write and are guarded or critical, 'supporting' for other writers and readers, else 'infrastructure'."""
    writes = x["effects"].groupBy("record_id").agg(F.max((F.col("effect") == "entities_written").cast("int")).alias("writes"))
    guards = x["boundaries"].select("record_id").distinct().withColumn("guarded", F.lit(True))
    j = x["flows"].select("record_id", "criticality").join(writes, "record_id", "left").join(guards, "record_id", "left")
    core = (F.col("writes") == 1) & (F.coalesce("guarded", F.lit(False)) | F.coalesce(F.col("criticality") == "critical", F.lit(False)))
    return j.select("record_id", F.when(core, "core").when(F.col("writes").isNotNull(), "supporting").otherwise("infrastructure").alias("role"))


add(
    "flow_roles",
    lambda t: _with(t, _flow_roles),
    fsql("""WITH w AS (SELECT record_id, max(CASE WHEN effect = 'entities_written' THEN 1 ELSE 0 END) AS writes FROM effects GROUP BY 1)
    SELECT record_id, CASE WHEN writes = 1 AND (record_id IN (SELECT record_id FROM bounds) OR coalesce(criticality = 'critical', false)) THEN 'core' WHEN writes IS NOT NULL THEN 'supporting' ELSE 'infrastructure' END AS role FROM flows LEFT JOIN w USING (record_id)"""),
)


def _lineage(x, page=50):
    """Entities by their exposure: writers, readers, unguarded writers; those with most unguarded writers first."""
    guards = x["boundaries"].select("record_id").distinct().withColumn("guarded", F.lit(1))
    e = x["effects"].where("effect in ('entities_written', 'entities_read')").select("record_id", "effect", F.lower("entity").alias("entity")).distinct().join(guards, "record_id", "left")
    write = F.col("effect") == "entities_written"
    sums = e.groupBy("entity").agg(F.count_if(write).alias("writers"), F.count_if(~write).alias("readers"), F.count_if(write & F.col("guarded").isNull()).alias("unguarded"))
    return select.page(sums, [F.col("unguarded").desc(), F.col("writers").desc(), "entity"], page)


add(
    "lineage_ranking",
    lambda t: _with(t, _lineage),
    fsql("""WITH e AS (SELECT DISTINCT record_id, effect, lower(entity) AS entity FROM effects WHERE effect IN ('entities_written', 'entities_read'))
    SELECT entity, count(*) FILTER (WHERE effect = 'entities_written') AS writers, count(*) FILTER (WHERE effect = 'entities_read') AS readers, count(*) FILTER (WHERE effect = 'entities_written' AND record_id NOT IN (SELECT record_id FROM bounds)) AS unguarded FROM e GROUP BY 1 ORDER BY unguarded DESC, writers DESC, entity LIMIT 50"""),
)

# -- changes and journeys -----------------------------------------------------------


def _sides(t, half):
    """Flows of the first or of the last delivery of a project and flow name, with guards and entities."""
    x = fl.tables(t)
    order = [F.col("record_id") if half == "before" else F.col("record_id").desc()]
    f = select.first_per_key(x["flows"].where("name is not null").select("project_id", "name", "record_id"), ["project_id", "name"], order)
    listed = lambda df, column, name: df.groupBy("record_id").agg(F.array_sort(F.collect_set(column)).alias(name))
    guards = listed(x["boundaries"].select("record_id", F.concat("name", F.lit(" ("), F.coalesce("mechanism", F.lit("")), F.lit(")")).alias("label")), "label", "guards")
    entities = listed(x["effects"].where("effect = 'entities_written'"), "entity", "entities")
    none = F.array().cast("array<string>")
    return f.join(guards, "record_id", "left").join(entities, "record_id", "left").select("project_id", "name", F.coalesce("guards", none).alias("guards"), F.coalesce("entities", none).alias("entities"))


add("behaviour_diff", lambda t: behaviour.flow_changes(_sides(t, "before"), _sides(t, "after"), ["project_id", "name"]).select("project_id", "name", "change", F.concat_ws("; ", "what").alias("what")), fsql("""WITH labels AS (SELECT record_id, name || ' (' || coalesce(mechanism, '') || ')' AS label FROM bounds), written AS (SELECT DISTINCT record_id, entity FROM effects WHERE effect = 'entities_written'),
    a AS (SELECT project_id, name, min(record_id) AS r FROM flows WHERE name IS NOT NULL GROUP BY 1, 2), b AS (SELECT project_id, name, max(record_id) AS r FROM flows WHERE name IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT a.project_id, a.name, coalesce((SELECT list(DISTINCT label) FROM labels WHERE record_id = a.r), []) AS g0, coalesce((SELECT list(DISTINCT label) FROM labels WHERE record_id = b.r), []) AS g1,
      coalesce((SELECT list(DISTINCT entity) FROM written WHERE record_id = a.r), []) AS e0, coalesce((SELECT list(DISTINCT entity) FROM written WHERE record_id = b.r), []) AS e1 FROM a JOIN b USING (project_id, name)),
    w AS (SELECT project_id, name, list_sort(list_concat(list_concat(CASE WHEN len(g0) > 0 AND len(g1) = 0 THEN ['lost guard'] ELSE list_transform(list_filter(g0, lambda x: NOT list_contains(g1, x)), lambda x: 'removed guard ' || x) END, list_transform(list_filter(g1, lambda x: NOT list_contains(g0, x)), lambda x: 'gained guard ' || x)),
      list_concat(list_transform(list_filter(e1, lambda x: NOT list_contains(e0, x)), lambda x: 'new entity ' || x), list_transform(list_filter(e0, lambda x: NOT list_contains(e1, x)), lambda x: 'removed entity ' || x)))) AS what FROM s)
    SELECT project_id, name, 'changed' AS change, array_to_string(what, '; ') AS what FROM w WHERE len(what) > 0"""))


def _journeys(t, kinds=("api", "ui", "http", "cli", "event", "job")):
    x = fl.tables(t)
    starts = x["flows"].where(F.col("flow_kind").isin(*kinds)).select(F.col("record_id").alias("id")).distinct()
    return behaviour.journeys(fl.links(x["steps"], x["flows"]), starts)


_WALK = """starts AS (SELECT DISTINCT record_id AS id FROM flows WHERE flow_kind IN ('api', 'ui', 'http', 'cli', 'event', 'job')), jwalk(start, id) AS (SELECT id, id FROM starts UNION SELECT w.start, l.target FROM jwalk w JOIN links l ON l.source = w.id),
    kept AS (SELECT * FROM jwalk WHERE start NOT IN (SELECT id FROM jwalk JOIN starts USING (id) WHERE id <> start))"""
add("engine_journeys", lambda t: _journeys(t).groupBy("start").agg(F.count("*").alias("flows")), fsql(f"WITH {_WALK} SELECT start, count(*) AS flows FROM kept GROUP BY 1"))
add("journey_page", lambda t: select.page(_journeys(t).groupBy("start").agg(F.count("*").alias("flows")).where("flows > 1"), [F.col("flows").desc(), "start"], 25), fsql(f"WITH {_WALK} SELECT start, count(*) AS flows FROM kept GROUP BY 1 HAVING count(*) > 1 ORDER BY flows DESC, start LIMIT 25"))


def _resolution(t):
    """Steps named in flows, resolved to units by file, project or unique name; a step's own file is unknown, so the handler's serves."""
    x = fl.tables(t)
    units = v.nodes(t, "id", "project_id", "file", "name").where("name is not null").distinct()
    home = x["flows"].select("record_id", "project_id", F.col("handler").alias("id")).join(units.select("id", "file"), "id", "left").select("record_id", "project_id", "file")
    refs = x["steps"].where("name is not null").join(home, "record_id").select(F.concat_ws("/", "record_id", "step_path").alias("ref"), "project_id", "file", "name").distinct()
    return behaviour.resolved(refs, units).groupBy("via").agg(F.count("*").alias("n"), F.count_distinct("id").alias("units"))


add(
    "name_resolution",
    _resolution,
    fsql("""WITH u AS (SELECT DISTINCT id, project_id, file, name FROM nodes WHERE name IS NOT NULL),
    refs AS (SELECT DISTINCT s.record_id || '/' || s.step_path AS ref, f.project_id, n.file, s.name FROM steps s JOIN flows f USING (record_id) LEFT JOIN u n ON n.id = f.handler WHERE s.name IS NOT NULL),
    a AS (SELECT project_id, file, name, min(id) AS id FROM u GROUP BY ALL HAVING count(*) = 1), b AS (SELECT project_id, name, min(id) AS id FROM u GROUP BY ALL HAVING count(*) = 1), c AS (SELECT name, min(id) AS id FROM u GROUP BY ALL HAVING count(*) = 1),
    j AS (SELECT r.ref, coalesce(a.id, b.id, c.id) AS id, CASE WHEN a.id IS NOT NULL THEN 'file' WHEN b.id IS NOT NULL THEN 'project' WHEN c.id IS NOT NULL THEN 'name' END AS via FROM refs r LEFT JOIN a ON a.project_id = r.project_id AND a.file = r.file AND a.name = r.name LEFT JOIN b ON b.project_id = r.project_id AND b.name = r.name LEFT JOIN c ON c.name = r.name)
    SELECT via, count(*) AS n, count(DISTINCT id) AS units FROM j GROUP BY 1""", "nodes"),
)


def _seams(t):
    """Exits of one project that enter another: a step's exit resource by its name and an entity that flows of other projects write."""
    x = fl.tables(t)
    homes = x["flows"].select("record_id", "project_id").distinct()
    read = x["effects"].where("effect = 'entities_read'").select("record_id", "entity").distinct().join(homes, "record_id").select(F.col("project_id").alias("from_project"), "entity").distinct()
    written = x["effects"].where("effect = 'entities_written'").select("record_id", "entity").distinct().join(homes, "record_id").select(F.col("project_id").alias("to_project"), "entity").distinct()
    return read.join(written, "entity").where("from_project <> to_project").groupBy("from_project", "to_project").agg(F.count("*").alias("entities"))


add(
    "seam_join",
    _seams,
    fsql("""WITH e AS (SELECT DISTINCT f.project_id, effect, entity FROM effects JOIN flows f USING (record_id))
    SELECT a.project_id AS from_project, b.project_id AS to_project, count(*) AS entities FROM e a JOIN e b USING (entity) WHERE a.effect = 'entities_read' AND b.effect = 'entities_written' AND a.project_id <> b.project_id GROUP BY 1, 2"""),
)


def _backfill(t):
    """Unmatched observations that a flow's route now fits, with the flow's entry point."""
    flows = fl.tables(t)["flows"].where("trigger like '/%' and entry_point_id is not null").select(fx.route_shape(F.col("trigger")).alias("shape"), "entry_point_id").groupBy("shape").agg(F.min("entry_point_id").alias("entry_point_id"))
    o = v.observations(t).where("coalesce(match_status, 'unmatched') = 'unmatched' and path like '/%'").select("id", fx.route_shape(F.col("path")).alias("shape"))
    return o.join(flows, "shape").select("id", "entry_point_id")


add(
    "backfill_matches",
    _backfill,
    fsql(f"WITH f AS (SELECT {_SHAPE.format('trigger')} AS shape, min(entry_point_id) AS entry_point_id FROM flows WHERE trigger LIKE '/%' AND entry_point_id IS NOT NULL GROUP BY 1) SELECT id, entry_point_id FROM (SELECT id, {_SHAPE.format('path')} AS shape FROM obs WHERE coalesce(match_status, 'unmatched') = 'unmatched' AND path LIKE '/%') JOIN f USING (shape)", "obs"),
)


def _product_map(t):
    """Per project: flows, guarded flows, entities written, external services, journeys that begin there."""
    x = fl.tables(t)
    homes = x["flows"].select("record_id", "project_id").distinct()
    guards = x["boundaries"].select("record_id").distinct().withColumn("g", F.lit(1))
    base = homes.join(guards, "record_id", "left").groupBy("project_id").agg(F.count_distinct("record_id").alias("flows"), F.count("g").alias("guarded"))
    effects = x["effects"].join(homes, "record_id").groupBy("project_id").agg(F.count_distinct(F.when(F.col("effect") == "entities_written", F.col("entity"))).alias("written"), F.count_distinct(F.when(F.col("effect") == "external_services", F.col("entity"))).alias("services"))
    starts = _journeys(t).select(F.col("start").alias("record_id")).distinct().join(homes, "record_id").groupBy("project_id").agg(F.count("*").alias("journeys"))
    return base.join(effects, "project_id", "left").join(starts, "project_id", "left").na.fill(0)


add(
    "product_map",
    _product_map,
    fsql(f"""WITH {_WALK}, h AS (SELECT DISTINCT record_id, project_id FROM flows)
    SELECT project_id, count(DISTINCT record_id) AS flows, count(*) FILTER (WHERE record_id IN (SELECT record_id FROM bounds)) AS guarded, coalesce((SELECT count(DISTINCT entity) FROM effects JOIN h x USING (record_id) WHERE x.project_id = h.project_id AND effect = 'entities_written'), 0) AS written,
      coalesce((SELECT count(DISTINCT entity) FROM effects JOIN h x USING (record_id) WHERE x.project_id = h.project_id AND effect = 'external_services'), 0) AS services, coalesce((SELECT count(DISTINCT start) FROM kept JOIN h x ON x.record_id = start WHERE x.project_id = h.project_id), 0) AS journeys FROM h GROUP BY 1"""),
)
