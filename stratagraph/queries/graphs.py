"""Queries over the graph of nodes and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.functions import text as fx
from stratagraph.operators import graph, select, shredding
from stratagraph.plans import views as v
from stratagraph.plans.views import with_views as sql
from stratagraph.queries import nested
from stratagraph.queries.registry import Registry
from stratagraph.session import durable

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
add = _r.add


def _calls(t):
    return durable(v.calls(t))


def _hubs(t, n=3):
    """The n nodes with most distinct callers, as seeds."""
    return v.calls(t).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "id").limit(n).select("id")


_HUBS = "hubs AS (SELECT target AS id FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)"
_SEEDS = "seeds AS (SELECT source AS id FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)"


def _seeds(t, n=3):
    return v.calls(t).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "id").limit(n).select("id")


def _levels(seeds: str, join: str, depth: int) -> str:
    """SQL of a walk with the least depth per node."""
    return f"""walk(id, depth) AS (SELECT id, 0 FROM {seeds} UNION SELECT {join.split('=')[0].strip()}, w.depth + 1 FROM walk w JOIN calls c ON {join.split('=')[1].strip()} = w.id WHERE w.depth < {depth})"""


add("callers", lambda t: graph.reach(graph.turned(_calls(t)), _hubs(t), 2).select("id", "depth"), sql(f"WITH {_HUBS}, {_levels('hubs', 'c.source=c.target', 2)} SELECT id, min(depth) AS depth FROM walk GROUP BY id", "calls", recursive=True))
add("callees", lambda t: graph.reach(_calls(t), _seeds(t), 2).select("id", "depth"), sql(f"WITH {_SEEDS}, {_levels('seeds', 'c.target=c.source', 2)} SELECT id, min(depth) AS depth FROM walk GROUP BY id", "calls", recursive=True))
_UP = "up(id) AS (SELECT id FROM hubs UNION SELECT c.source FROM up JOIN calls c ON c.target = up.id)"
_DOWN = "down(id) AS (SELECT id FROM seeds UNION SELECT c.target FROM down JOIN calls c ON c.source = down.id)"
add("affected_set", lambda t: graph.reach(graph.turned(_calls(t)), _hubs(t)).where("depth > 0").select("id"), sql(f"WITH {_HUBS}, {_UP} SELECT id FROM up WHERE id NOT IN (SELECT id FROM hubs)", "calls", recursive=True))
add("forward_closure", lambda t: graph.reach(_calls(t), _seeds(t)).select("id"), sql(f"WITH {_SEEDS}, {_DOWN} SELECT id FROM down", "calls", recursive=True))
add("reachability_edges", lambda t: v.calls(t), "SELECT DISTINCT source, target FROM cas_edge WHERE type IN ('calls', 'invokes') AND target IS NOT NULL AND source <> target")


def _slice(t):
    inside = graph.reach(_calls(t), _seeds(t)).select("id")
    e = v.edges(t, "source", "target").where("target is not null").select("id", "source", "target")
    return e.join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_semi").select("id", "source", "target")


add("deployable_slice", _slice, sql(f"WITH {_SEEDS}, {_DOWN} SELECT id, source, target FROM edges WHERE source IN (SELECT id FROM down) AND target IN (SELECT id FROM down)", "calls", "edges", recursive=True))
add("executable_graph", lambda t: v.calls(t).join(v.nodes(t).where("type in ('function', 'method')").select(F.col("id").alias("source")), "source", "left_semi").select("source", "target"), sql("SELECT source, target FROM calls WHERE source IN (SELECT id FROM nodes WHERE type IN ('function', 'method'))", "calls", "nodes"))




add("components", lambda t: graph.components(_calls(t)))
add("strong_components", lambda t: graph.strong_components(_calls(t)))
add("terminality", lambda t: graph.terminality(_calls(t)))
add("communities", lambda t: graph.communities(_calls(t)))


def _coupling(t):
    own = v.edge_rows(t).where("target is not null and source <> target").select("source", "target", F.substring_index("source", ":", 1).alias("a"), F.substring_index("target", ":", 1).alias("b")).distinct().where("a <> b")
    callers = own.groupBy("target").agg(F.count_distinct("source").alias("fan_in")).where("fan_in >= 8")
    rare = own.groupBy("a", "b").agg(F.count("*").alias("links"))
    return select.page(own.join(callers, "target").join(rare, ["a", "b"]).select("source", "target", "fan_in", "links"), [F.col("fan_in").desc(), "links", "source", "target"], 20)


add("surprising_coupling", _coupling, sql("WITH o AS (SELECT DISTINCT source, target, string_split(source, ':')[1] AS a, string_split(target, ':')[1] AS b FROM edges WHERE target IS NOT NULL AND source <> target), x AS (SELECT * FROM o WHERE a <> b) SELECT source, target, fan_in, links FROM x JOIN (SELECT target, count(DISTINCT source) AS fan_in FROM x GROUP BY 1 HAVING count(DISTINCT source) >= 8) USING (target) JOIN (SELECT a, b, count(*) AS links FROM x GROUP BY 1, 2) USING (a, b) ORDER BY fan_in DESC, links, source, target LIMIT 20", "edges"))


def _scope(t):
    pairs = graph.pairs_of(v.edge_rows(t))
    return graph.reach(durable(pairs.union(graph.turned(pairs)).distinct()), _seeds(t), 2).select("id", "depth")


add("neighbourhood_scope", _scope, sql(f"WITH {_SEEDS}, e AS (SELECT DISTINCT source, target FROM edges WHERE target IS NOT NULL AND source <> target), both_ways AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), walk(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON a = id WHERE depth < 2) SELECT id, min(depth) AS depth FROM walk GROUP BY id", "calls", "edges", recursive=True))


def _entries(t):
    """Handlers of flow entries."""
    objects = shredding.flow_objects(t("entry_point_flow"), {"handler_node_id": "handler_node_id", "node_id": "node_id"})
    return objects.where("label in ('entry', 'handler') and list_label is null").select(F.coalesce("handler_node_id", F.when(F.col("label") == "handler", F.col("node_id"))).alias("id")).where("id is not null").distinct()


add("entry_reach", lambda t: graph.reach_counts(_calls(t), _entries(t)),
    sql(f"WITH s AS ({nested.HANDLERS_SQL}), walk(seed, id) AS (SELECT id, id FROM s UNION SELECT w.seed, c.target FROM walk w JOIN calls c ON c.source = w.id) SELECT seed, count(*) AS reached FROM walk GROUP BY 1", "calls", recursive=True))
add("structural_context", lambda t: v.edges(t, "source", "target", "type").where("type = 'contains' and target is not null").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("children"), F.min("target").alias("first_child")), sql("SELECT source AS id, count(*) AS children, min(target) AS first_child FROM edges WHERE type = 'contains' AND target IS NOT NULL GROUP BY 1", "edges"))
add("ancestors", lambda t: graph.ancestors(v.nodes(t).select("id", "parent")).groupBy("id").agg(F.count("*").alias("ancestors"), F.max("distance").alias("depth")), sql("WITH p AS (SELECT DISTINCT id, parent FROM nodes WHERE parent IS NOT NULL AND parent <> id), walk(id, ancestor, distance) AS (SELECT id, parent, 1 FROM p UNION SELECT w.id, p.parent, w.distance + 1 FROM walk w JOIN p ON p.id = w.ancestor WHERE w.distance < 64 AND p.parent <> w.id), least AS (SELECT id, ancestor, min(distance) AS d FROM walk GROUP BY 1, 2) SELECT id, count(*) AS ancestors, max(d) AS depth FROM least GROUP BY 1", "nodes", recursive=True))
add("component_parents", lambda t: v.edge_rows(t).where("type = 'references' and target is not null").groupBy("target").agg(F.count_distinct("source").alias("parents")).select("target", "parents", (F.col("parents") >= 2).alias("shared"), (F.col("parents") >= 5).alias("highly_shared")), sql("SELECT target, count(DISTINCT source) AS parents, count(DISTINCT source) >= 2 AS shared, count(DISTINCT source) >= 5 AS highly_shared FROM edges WHERE type = 'references' AND target IS NOT NULL GROUP BY 1", "edges"))
add("component_children", lambda t: v.edge_rows(t).where("type = 'references' and target is not null").groupBy("source").agg(F.count_distinct("target").alias("children")), sql("SELECT source, count(DISTINCT target) AS children FROM edges WHERE type = 'references' AND target IS NOT NULL GROUP BY 1", "edges"))


def _layering(t):
    rank = F.create_map(*(F.lit(x) for p in {"structure": 0, "behaviour": 1, "data": 2}.items() for x in p))
    n = v.nodes(t).where("not coalesce(is_test, false) and category is not null").select("id", "category")
    joined = v.calls(t).join(n.withColumnsRenamed({"id": "source", "category": "from_layer"}), "source").join(n.withColumnsRenamed({"id": "target", "category": "to_layer"}), "target")
    return joined.groupBy("from_layer", "to_layer").agg(F.count("*").alias("n"), F.max((rank[F.col("from_layer")] > rank[F.col("to_layer")]).cast("int")).alias("against"))


add("layer_transitions", _layering, sql("SELECT a.category AS from_layer, b.category AS to_layer, count(*) AS n, max(CASE WHEN MAP {'structure': 0, 'behaviour': 1, 'data': 2}[a.category] > MAP {'structure': 0, 'behaviour': 1, 'data': 2}[b.category] THEN 1 WHEN MAP {'structure': 0, 'behaviour': 1, 'data': 2}[a.category] IS NOT NULL AND MAP {'structure': 0, 'behaviour': 1, 'data': 2}[b.category] IS NOT NULL THEN 0 END) AS against FROM calls c JOIN nodes a ON a.id = c.source AND NOT coalesce(a.is_test, false) AND a.category IS NOT NULL JOIN nodes b ON b.id = c.target AND NOT coalesce(b.is_test, false) AND b.category IS NOT NULL GROUP BY 1, 2", "calls", "nodes"))
add("method_call_lists", lambda t: v.calls(t).select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("made"), F.lit(0).alias("received")), F.struct(F.col("target").alias("id"), F.lit(0).alias("made"), F.lit(1).alias("received")))).alias("x")).groupBy("x.id").agg(F.sum("x.made").alias("made_by"), F.sum("x.received").alias("received_by")), sql("SELECT id, CAST(sum(m) AS BIGINT) AS made_by, CAST(sum(r) AS BIGINT) AS received_by FROM (SELECT source AS id, 1 AS m, 0 AS r FROM calls UNION ALL SELECT target, 0, 1 FROM calls) GROUP BY id", "calls"))


def _flow_links(t):
    """Flows that go on in another flow: a step's node is the handler of the other's entry."""
    steps = shredding.flow_steps(t("entry_point_flow")).where("node_id is not null").select("record", "node_id").distinct()
    objects = shredding.flow_objects(t("entry_point_flow"), {"handler_node_id": "handler_node_id", "node_id": "node_id"})
    handlers = objects.where("label in ('entry', 'handler') and list_label is null").select(F.col("record").alias("next_record"), F.coalesce("handler_node_id", "node_id").alias("node_id")).where("node_id is not null").distinct()
    return steps.join(handlers, "node_id").where("record <> next_record").select("record", "next_record").distinct()


add("flow_continuations", lambda t: _flow_links(t))
add("flow_summary", lambda t: shredding.flow_steps(t("entry_point_flow")).groupBy("record").agg(F.count("*").alias("steps"), F.max(F.size(F.split("step_path", r"\."))).alias("depth"), F.count_if(F.col("node_id").isNull()).alias("unresolved")).withColumnRenamed("record", "record_id"))
add("concept_index", lambda t: shredding.flow_steps(t("entry_point_flow")).where("node_id is not null").groupBy("node_id").agg(F.count_distinct("record").alias("flows")))
add("security_boundaries", lambda t: shredding.flow_objects(t("entry_point_flow"), {"name": "name", "mechanism": "mechanism"}).where("list_label = 'security_boundaries'").groupBy("mechanism").agg(F.count_distinct("record").alias("flows"), F.count_distinct("name").alias("names")))
add("entity_relations", lambda t: v.edge_rows(t).where("type = 'depends_on' and target is not null").groupBy("source").agg(F.count_distinct("target").alias("targets"), F.max("occurrences").alias("most")).select("source", "targets", F.when(F.col("most") > 1, "1:N").otherwise("1:1").alias("cardinality")), sql("SELECT source, count(DISTINCT target) AS targets, CASE WHEN max(occurrences) > 1 THEN '1:N' ELSE '1:1' END AS cardinality FROM edges WHERE type = 'depends_on' AND target IS NOT NULL GROUP BY 1", "edges"))
add("er_model", lambda t: v.nodes(t).where("type = 'class'").select("id", "name", F.coalesce(fx.language_of(F.col("file")), F.lit("?")).alias("language")), sql("SELECT id, name, coalesce(map_extract(MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in fx.LANGUAGES.items()) + "}, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)))[1], '?') AS language FROM nodes WHERE type = 'class'", "nodes"))
