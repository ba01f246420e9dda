"""Queries of links between repositories (projects) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.functions import text as fx
from stratagraph.operators import crosslinks as cl
from stratagraph.plans import flows as fl
from stratagraph.plans import views as v
from stratagraph.queries.behaviour import _SHAPE, fsql
from stratagraph.queries.registry import Registry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
add = _r.add


def _libraries(t):
    used = v.edge_rows(t).select("project_id", F.col("target").alias("id")).distinct().join(t("shared_node").select("id", "library"), "id")
    return cl.shared(used.select(F.col("project_id").alias("repo"), F.col("library").alias("contract")), "shared-library", 0.6)


def _entities(x):
    e = x["effects"].where("effect = 'entities_written'").join(x["flows"].select("record_id", "project_id").distinct(), "record_id")
    return cl.shared(e.select(F.col("project_id").alias("repo"), F.lower("entity").alias("contract")), "shared-database", 0.8)


def _services(x):
    """Flows that call a service by the name of an entity that only one other repository writes."""
    homes = x["flows"].select("record_id", "project_id").distinct()
    of = lambda effect: x["effects"].where(F.col("effect") == effect).join(homes, "record_id").select(F.col("project_id").alias("repo"), F.lower("entity").alias("contract"))
    return cl.used(of("external_services"), of("entities_written"), "api", 0.82)


def _messages(x):
    """Repositories that emit a message of an entity's name to the only repository that writes the entity."""
    homes = x["flows"].select("record_id", "project_id").distinct()
    of = lambda effect: x["effects"].where(F.col("effect") == effect).join(homes, "record_id").select(F.col("project_id").alias("repo"), F.lower("entity").alias("contract"))
    return cl.used(of("messages_emitted"), of("entities_written"), "message", 0.78)


def _routes(t, x):
    """Repositories with flows of one route shape."""
    shapes = x["flows"].where("trigger like '/%'").select(F.col("project_id").alias("repo"), fx.route_shape(F.col("trigger")).alias("contract"))
    return cl.shared(shapes, "api", 0.9)


def _imports(t):
    """Declared types named like the package (the last but one part of a qualified name) that one other project alone has."""
    names = v.nodes(t, "project_id", "qualified_name").where("qualified_name like '%.%'").select(F.col("project_id").alias("repo"), F.lower(F.element_at(F.split("qualified_name", r"\."), -2)).alias("contract"))
    types = F.concat(F.coalesce(F.col("signature.parameters.type"), F.array()), F.array(F.col("signature.return_type")))
    uses = t("cas_node").select(F.col("project_id").alias("repo"), F.explode(types).alias("declared")).distinct().select("repo", F.lower(fx.type_shape(F.col("declared"))["name"]).alias("contract")).where("contract is not null")
    return cl.used(uses, names, "namespace-import", 0.85)


def _schemas(t):
    n = v.nodes(t, "project_id", "name", "type", "is_exported").where("type in ('class', 'interface')")
    return n.select(F.col("project_id").alias("repo"), fx.entity_key(F.col("name")).alias("contract"), F.coalesce("is_exported", F.lit(False)).alias("exact"))


def _all(t):
    x = fl.tables(t)
    direct = [_routes(t, x), _entities(x), _services(x), _messages(x)]
    known = cl.united(*direct)
    return cl.united(*direct, cl.schemas_under_contract(_schemas(t), known), _libraries(t))


def _shared_sql(kind: str, confidence: float, holds: str) -> str:
    return f"SELECT '{kind}' AS type, contract, hub AS source_repo, repo AS target_repo, {confidence}::DOUBLE AS confidence FROM (SELECT *, min(repo) OVER (PARTITION BY contract) AS hub FROM (SELECT DISTINCT repo, contract FROM ({holds}) WHERE repo IS NOT NULL AND contract IS NOT NULL)) WHERE repo <> hub"


def _used_sql(kind: str, confidence: float, uses: str, provides: str) -> str:
    return f"SELECT DISTINCT '{kind}' AS type, u.contract, u.repo AS source_repo, p.repo AS target_repo, {confidence}::DOUBLE AS confidence FROM ({uses}) u JOIN (SELECT contract, min(repo) AS repo FROM ({provides}) WHERE repo IS NOT NULL AND contract IS NOT NULL GROUP BY 1 HAVING count(DISTINCT repo) = 1) p ON p.contract = u.contract AND p.repo <> u.repo"


def _effect(name: str) -> str:
    return f"SELECT f.project_id AS repo, lower(entity) AS contract FROM effects JOIN flows f USING (record_id) WHERE effect = '{name}'"


_L_LIB = _shared_sql("shared-library", 0.6, "SELECT e.project_id AS repo, s.library AS contract FROM cas_edge e JOIN shared_node s ON s.id = e.target")
_L_DB = _shared_sql("shared-database", 0.8, _effect("entities_written"))
_L_API = _shared_sql("api", 0.9, f"SELECT project_id AS repo, {_SHAPE.format('trigger')} AS contract FROM flows WHERE trigger LIKE '/%'")
_L_SERVICE = _used_sql("api", 0.82, _effect("external_services"), _effect("entities_written"))
_L_MESSAGE = _used_sql("message", 0.78, _effect("messages_emitted"), _effect("entities_written"))
_UNITED = f"""direct AS ({_L_API} UNION ALL {_L_DB} UNION ALL {_L_SERVICE} UNION ALL {_L_MESSAGE}),
    schemas AS (SELECT project_id AS repo, regexp_replace(regexp_replace(lower(name), '^entity_', ''), '[^a-z0-9]', '', 'g') AS contract, bool_or(coalesce(is_exported, false)) AS exact FROM nodes WHERE type IN ('class', 'interface') GROUP BY 1, 2),
    met AS (SELECT DISTINCT source_repo, target_repo FROM direct WHERE confidence >= 0.75),
    everything AS (SELECT type, contract, source_repo, target_repo, confidence FROM direct UNION ALL SELECT 'shared-schema', a.contract, source_repo, target_repo, CASE WHEN a.exact AND b.exact THEN 0.93::DOUBLE ELSE 0.81::DOUBLE END FROM met JOIN schemas a ON a.repo = source_repo JOIN schemas b ON b.repo = target_repo AND b.contract = a.contract UNION ALL {_L_LIB}),
    linked AS (SELECT type || ':' || source_repo || ':' || target_repo || ':' || contract AS id, type, contract, source_repo, target_repo, max(confidence) AS confidence, CASE WHEN max(confidence) >= 0.9 THEN 'confirmed' WHEN max(confidence) >= 0.75 THEN 'likely' ELSE 'possible' END AS certainty FROM everything GROUP BY ALL)"""

add("library_links", _libraries, _L_LIB)
add("database_links", lambda t: _entities(fl.tables(t)), fsql(" " + _L_DB))
add("service_links", lambda t: _services(fl.tables(t)), fsql(" " + _L_SERVICE))
add("message_links", lambda t: _messages(fl.tables(t)), fsql(" " + _L_MESSAGE))
add("route_links", lambda t: _routes(t, fl.tables(t)), fsql(" " + _L_API))
add("namespace_imports", _imports)
add("cross_repo_links", _all, fsql(f"WITH {_UNITED} SELECT * FROM linked", "nodes"))
add("link_certainty", lambda t: _all(t).groupBy("certainty", "type").agg(F.count("*").alias("n")), fsql(f"WITH {_UNITED} SELECT certainty, type, count(*) AS n FROM linked GROUP BY 1, 2", "nodes"))


def _journeys(t):
    """Links by route followed to the flows on both sides and the entities that the far side writes."""
    x = fl.tables(t)
    shapes = x["flows"].where("trigger like '/%'").select("record_id", "project_id", fx.route_shape(F.col("trigger")).alias("contract"))
    writes = x["effects"].where("effect = 'entities_written'").select("record_id", "entity")
    near = _routes(t, x).join(shapes.select(F.col("project_id").alias("source_repo"), "contract", F.col("record_id").alias("from_flow")), ["source_repo", "contract"])
    far = shapes.join(writes, "record_id").groupBy(F.col("project_id").alias("target_repo"), "contract").agg(F.count_distinct("record_id").alias("flows"), F.concat_ws(",", F.array_sort(F.collect_set("entity"))).alias("entities"))
    return near.join(far, ["target_repo", "contract"]).select("from_flow", "source_repo", "target_repo", "contract", "flows", "entities").distinct()


add(
    "cross_repo_journeys",
    _journeys,
    fsql(f"""WITH l AS ({_L_API}), s AS (SELECT DISTINCT record_id, project_id, {_SHAPE.format('trigger')} AS contract FROM flows WHERE trigger LIKE '/%'),
    far AS (SELECT project_id AS target_repo, contract, count(DISTINCT record_id) AS flows, array_to_string(list_sort(list(DISTINCT entity)), ',') AS entities FROM s JOIN effects USING (record_id) WHERE effect = 'entities_written' GROUP BY 1, 2)
    SELECT DISTINCT s.record_id AS from_flow, l.source_repo, l.target_repo, l.contract, far.flows, far.entities FROM l JOIN s ON s.project_id = l.source_repo AND s.contract = l.contract JOIN far ON far.target_repo = l.target_repo AND far.contract = l.contract"""),
)


def _topics(x):
    """Topics of messages with the repositories that emit them and those whose flows write the entity of that name."""
    homes = x["flows"].select("record_id", "project_id").distinct()
    of = lambda effect, name: x["effects"].where(F.col("effect") == effect).join(homes, "record_id").groupBy(F.lower("entity").alias("topic")).agg(F.count_distinct("project_id").alias(name))
    return of("messages_emitted", "producers").join(of("entities_written", "consumers"), "topic", "left").select("topic", "producers", F.coalesce("consumers", F.lit(0)).alias("consumers"))


add(
    "messages_by_topic",
    lambda t: _topics(fl.tables(t)),
    fsql("""WITH e AS (SELECT lower(entity) AS topic, effect, project_id FROM effects JOIN flows USING (record_id))
    SELECT p.topic, count(DISTINCT p.project_id) AS producers, (SELECT count(DISTINCT c.project_id) FROM e c WHERE c.topic = p.topic AND c.effect = 'entities_written') AS consumers FROM e p WHERE effect = 'messages_emitted' GROUP BY 1"""),
)

_READS = r"(?:process\.env\.|environ\[[\"']|environ\.get\([\"']|[Gg]etenv\([\"'])([A-Z][A-Z0-9_]*)"


def _environment(t):
    """Names that files read from their environment: in how many files and workspaces, and whether the name speaks of an endpoint."""
    read = t("in_flight_diff_file").where("content is not null").select("diff_id", "workspace_id", F.explode(F.regexp_extract_all("content", F.lit(_READS), F.lit(1))).alias("name"))
    sums = read.groupBy("name").agg(F.count_distinct("diff_id").alias("files"), F.count_distinct("workspace_id").alias("workspaces"))
    return sums.withColumn("endpoint", F.lower("name").rlike("url|uri|endpoint|base|host|graphql|grpc|webhook"))


add("environment_contracts", _environment, "WITH r AS (SELECT diff_id, workspace_id, unnest(regexp_extract_all(content, '" + _READS.replace("'", "''") + "', 1)) AS name FROM in_flight_diff_file WHERE content IS NOT NULL) SELECT name, count(DISTINCT diff_id) AS files, count(DISTINCT workspace_id) AS workspaces, regexp_matches(lower(name), 'url|uri|endpoint|base|host|graphql|grpc|webhook') AS endpoint FROM r GROUP BY 1")


def _composed(t):
    """The whole made of all projects' latest analyses: projects, nodes and edges as announced, links between projects and shared units they reach."""
    latest = t("analysis_entry").where("project_id is not null").groupBy("project_id").agg(F.max_by(F.struct("node_count", "edge_count"), F.struct("snapshot_no", "analyzed_at", "node_count", "edge_count")).alias("r"))
    parts = latest.agg(F.count("*").alias("projects"), F.sum("r.node_count").alias("nodes"), F.sum("r.edge_count").alias("edges"))
    e = v.edge_rows(t).where("target is not null").select(F.substring_index("source", ":", 1).alias("a"), F.substring_index("target", ":", 1).alias("b"), "target").distinct()
    links = e.where("a <> b").agg(F.count_distinct(F.when(F.col("b") != "lib", F.struct("a", "b"))).alias("project_links"), F.count_distinct(F.when(F.col("b") == "lib", F.col("target"))).alias("shared_units"))
    return parts.join(F.broadcast(links))  # one row each


add(
    "composed_analysis",
    _composed,
    """WITH l AS (SELECT project_id, node_count, edge_count FROM analysis_entry WHERE project_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY snapshot_no DESC NULLS LAST, analyzed_at DESC NULLS LAST, node_count DESC NULLS LAST, edge_count DESC NULLS LAST) = 1),
    e AS (SELECT DISTINCT string_split(source, ':')[1] AS a, string_split(target, ':')[1] AS b, target FROM cas_edge WHERE target IS NOT NULL)
    SELECT count(*) AS projects, CAST(sum(node_count) AS BIGINT) AS nodes, CAST(sum(edge_count) AS BIGINT) AS edges, (SELECT count(DISTINCT (a, b)) FROM e WHERE a <> b AND b <> 'lib') AS project_links, (SELECT count(DISTINCT target) FROM e WHERE b = 'lib' AND a <> b) AS shared_units FROM l""",
)
