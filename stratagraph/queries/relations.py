"""Queries of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.functions import text as fx
from stratagraph.operators import graph, history, ordered, select, shredding, snapshots
from stratagraph.session import durable
from stratagraph.plans import views as v
from stratagraph.plans.views import with_views as sql
from stratagraph.queries.registry import Registry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
add = _r.add

# -- joins ---------------------------------------------------------------------
add("edge_node_join", lambda t: v.edges(t, "source", "target", "type").join(v.nodes(t).select(F.col("id").alias("source"), F.col("type").alias("source_type")), "source").join(v.nodes(t).select(F.col("id").alias("target"), F.col("type").alias("target_type")), "target").groupBy("source_type", "type", "target_type").agg(F.count("*").alias("n")),
    sql("SELECT a.type AS source_type, e.type, b.type AS target_type, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target GROUP BY 1, 2, 3", "nodes", "edges"))
add("scope_semi_join", lambda t: v.edges(t, "source", "target").join(v.nodes(t).where("category = 'domain'").select(F.col("id").alias("source")), "source", "left_semi").join(v.nodes(t).where("category = 'domain'").select(F.col("id").alias("target")), "target", "left_semi").select("id", "source", "target"),
    sql("SELECT id, source, target FROM edges WHERE source IN (SELECT id FROM nodes WHERE category = 'domain') AND target IN (SELECT id FROM nodes WHERE category = 'domain')", "nodes", "edges"))


def _dead(t):
    used = v.edge_rows(t).where("type in ('calls', 'uses', 'depends_on') and target is not null").select(F.col("target").alias("id"))
    units = v.nodes(t).where("type in ('function', 'method') and not coalesce(is_test, false) and not coalesce(is_exported, false)")
    return units.join(used, "id", "left_anti").select("id", "name", "file")


add("dead_code", _dead, sql("SELECT id, name, file FROM nodes n WHERE type IN ('function', 'method') AND NOT coalesce(is_test, false) AND NOT coalesce(is_exported, false) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target = n.id AND e.type IN ('calls', 'uses', 'depends_on'))", "nodes", "edges"))


def _dead_reasons(t):
    inbound = v.edges(t, "source", "target", "type").where("target is not null and type in ('calls', 'invokes')").join(v.nodes(t).select(F.col("id").alias("source"), F.coalesce("is_test", F.lit(False)).alias("from_test")), "source").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("inbound"), F.count_if("from_test").alias("tests"))
    n = v.nodes(t).select("id", "is_exported").join(inbound, "id", "left")
    reason = F.when(F.col("inbound").isNull() & F.coalesce("is_exported", F.lit(False)), "exported-unused").when(F.col("inbound").isNull(), "no-inbound").when(F.col("inbound") == F.col("tests"), "only-from-tests")
    return n.select("id", reason.alias("reason")).where("reason is not null")


add("dead_code_reasons", _dead_reasons, sql("""WITH i AS (SELECT target AS id, count(*) AS n, count(*) FILTER (WHERE coalesce(s.is_test, false)) AS tests FROM edges e JOIN nodes s ON s.id = e.source WHERE target IS NOT NULL AND e.type IN ('calls', 'invokes') GROUP BY 1)
    SELECT id, reason FROM (SELECT n.id, CASE WHEN i.n IS NULL AND coalesce(n.is_exported, false) THEN 'exported-unused' WHEN i.n IS NULL THEN 'no-inbound' WHEN i.n = i.tests THEN 'only-from-tests' END AS reason FROM nodes n LEFT JOIN i USING (id)) WHERE reason IS NOT NULL""", "nodes", "edges"))


def _unresolved(t):
    """Per type of edge: edges without a target, and edges whose target is no node."""
    known = v.nodes(t, "id").unionByName(t("shared_node").select("id")).distinct().select(F.col("id").alias("target"), F.lit(True).alias("known"))
    e = v.edges(t, "type", "target").join(known, "target", "left")
    return e.groupBy("type").agg(F.count_if(F.col("target").isNull()).alias("unresolved"), F.count_if(F.col("target").isNotNull() & F.col("known").isNull()).alias("dangling"))


add("dangling_edges", _unresolved, sql("SELECT type, count(*) FILTER (WHERE target IS NULL) AS unresolved, count(*) FILTER (WHERE target IS NOT NULL AND target NOT IN (SELECT id FROM nodes UNION ALL SELECT id FROM shared_node)) AS dangling FROM edges GROUP BY 1", "nodes", "edges"))
add("duplicate_ids", lambda t: t("cas_edge").groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "SELECT id, count(*) AS n FROM cas_edge GROUP BY id HAVING count(*) > 1")


def _snapshot_pairs(t):
    """project_id, snapshot_no and before: each complete snapshot with the nearest earlier complete one."""
    keys = t("cas_node").select(F.col("project_id").alias("grp"), F.col("snapshot_no").alias("version"), F.col("id").alias("key")).dropna().distinct()
    sizes = keys.groupBy("grp", "version").agg(F.count("*").alias("size"))
    announced = t("analysis_entry").select(F.col("project_id").alias("grp"), F.col("snapshot_no").alias("version"), F.col("node_count").alias("size"))
    return snapshots.consecutive(sizes, announced).where("before is not null").toDF(*_PAIR)


_PAIR = ["project_id", "snapshot_no", "before"]
_PAIRS_SQL = """sizes AS (SELECT project_id, snapshot_no, count(DISTINCT id) AS node_count FROM cas_node WHERE project_id IS NOT NULL AND snapshot_no IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2),
    pairs AS (SELECT * FROM (SELECT project_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY project_id ORDER BY snapshot_no) AS before FROM sizes SEMI JOIN analysis_entry USING (project_id, snapshot_no, node_count)) WHERE before IS NOT NULL)"""


def _both_sides(t, flat):
    """Rows of the earlier and of the later snapshot of each pair; ``flat`` has project_id and snapshot_no."""
    pairs = _snapshot_pairs(t)
    return flat.withColumnRenamed("snapshot_no", "before").join(pairs, ["project_id", "before"]), flat.join(pairs, ["project_id", "snapshot_no"])


def _snapshot_sets(t):
    a, b = _both_sides(t, t("cas_node").select("project_id", "snapshot_no", "id").dropna().distinct())
    only = lambda x, y, change: x.join(y.select(*_PAIR, "id"), [*_PAIR, "id"], "left_anti").groupBy(*_PAIR).agg(F.count("*").alias("n")).withColumn("change", F.lit(change))
    return only(a, b, "deleted").unionByName(only(b, a, "added"))


add("snapshot_added_removed", _snapshot_sets, f"""WITH {_PAIRS_SQL}, f AS (SELECT DISTINCT project_id, snapshot_no, id FROM cas_node WHERE id IS NOT NULL)
    SELECT p.project_id, p.snapshot_no, p.before, count(*) AS n, 'deleted' AS change FROM pairs p JOIN f a ON a.project_id = p.project_id AND a.snapshot_no = p.before WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.project_id = p.project_id AND b.snapshot_no = p.snapshot_no AND b.id = a.id) GROUP BY ALL
    UNION ALL SELECT p.project_id, p.snapshot_no, p.before, count(*), 'added' FROM pairs p JOIN f b ON b.project_id = p.project_id AND b.snapshot_no = p.snapshot_no WHERE NOT EXISTS (SELECT 1 FROM f a WHERE a.project_id = p.project_id AND a.snapshot_no = p.before AND a.id = b.id) GROUP BY ALL""")


def _renames(t):
    a, b = _both_sides(t, t("cas_node").select("project_id", "snapshot_no", "id", "name", "type", F.col("source.file").alias("file"), F.size("signature.parameters").alias("parameters")).where("id is not null").distinct())
    keys = [*_PAIR, "type", "file", "parameters"]
    only = lambda x, y: x.join(y.select(*_PAIR, "id"), [*_PAIR, "id"], "left_anti")
    unique = lambda x, name: x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    return unique(only(a, b), "old_id").join(unique(only(b, a), "new_id"), keys).select(*_PAIR, "old_id", "new_id")


add("rename_match", _renames, f"""WITH {_PAIRS_SQL}, f AS (SELECT DISTINCT project_id, snapshot_no, id, name, type, source.file AS file, len(signature.parameters) AS parameters FROM cas_node WHERE id IS NOT NULL),
    x AS (SELECT p.project_id, p.snapshot_no, p.before, type, file, parameters, min(id) AS old_id FROM pairs p JOIN f a ON a.project_id = p.project_id AND a.snapshot_no = p.before WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.project_id = p.project_id AND b.snapshot_no = p.snapshot_no AND b.id = a.id) GROUP BY ALL HAVING count(*) = 1),
    y AS (SELECT p.project_id, p.snapshot_no, p.before, type, file, parameters, min(id) AS new_id FROM pairs p JOIN f b ON b.project_id = p.project_id AND b.snapshot_no = p.snapshot_no WHERE NOT EXISTS (SELECT 1 FROM f a WHERE a.project_id = p.project_id AND a.snapshot_no = p.before AND a.id = b.id) GROUP BY ALL HAVING count(*) = 1)
    SELECT project_id, snapshot_no, before, old_id, new_id FROM x JOIN y USING (project_id, snapshot_no, before, type, file, parameters)""")


def _breaking(t):
    sides = t("cas_node").where("metadata.is_exported").select("project_id", "snapshot_no", "id", F.to_json(F.transform("signature.parameters", lambda p: p["type"])).alias("sig"), F.col("signature.return_type").alias("returns"))
    a, b = _both_sides(t, sides)
    before = a.groupBy(*_PAIR, "id").agg(F.max("sig").alias("old_sig"), F.max("returns").alias("old_returns"))
    after = b.groupBy(*_PAIR, "id").agg(F.max("sig").alias("sig"), F.max("returns").alias("returns"), F.lit(True).alias("there"))
    kind = F.when(F.col("there").isNull(), "removed").when(~F.col("sig").eqNullSafe(F.col("old_sig")), "signature").when(~F.col("returns").eqNullSafe(F.col("old_returns")), "type-change")
    return before.join(after, [*_PAIR, "id"], "left").select(*_PAIR, "id", kind.alias("kind")).where("kind is not null")


add("breaking_changes", _breaking)


def _stack_frames(t):
    """The unit that each of the first five frames of an error ran in: the narrowest in a compatible file around its line, else the only one of its name.

    Of units of one span functions and methods come before classes and others.
    """
    frames = t("observation").where("event.error is not null").select("id", F.posexplode(F.slice("event.error.frames", 1, 5)).alias("pos", "f")).select("id", "pos", fx.clean_path(F.col("f.file")).alias("frame_file"), F.col("f.line").alias("frame_line"), F.col("f.function").alias("function"))
    units = v.nodes(t, "id", "name", "type", "file", "line", "end_line")
    spots = units.where("file is not null and line is not null").select(F.col("id").alias("node_id"), fx.clean_path(F.col("file")).alias("file"), "line", "end_line", (~F.col("type").isin("function", "method")).cast("int").alias("later"))
    joined = frames.where("frame_file is not null").withColumn("base", fx.base_name(F.col("frame_file"))).join(spots.withColumn("base", fx.base_name(F.col("file"))), "base")
    inside = joined.where(fx.paths_compatible(F.col("frame_file"), F.col("file")) & F.col("frame_line").between(F.col("line"), F.col("end_line")))
    around = select.first_per_key(inside, ["id", "pos"], [F.col("end_line") - F.col("line"), F.col("later"), F.col("node_id")]).select("id", "pos", F.col("node_id").alias("around"))
    named = units.where("name is not null").groupBy(F.col("name").alias("function")).agg(F.count("*").alias("n"), F.min("id").alias("by_name")).where("n = 1").drop("n")
    found = frames.join(around, ["id", "pos"], "left").join(named, "function", "left")
    return found.select("id", "pos", F.coalesce("around", "by_name").alias("node_id"), F.when(F.col("around").isNotNull(), "line").otherwise("name").alias("via")).where("node_id is not null")


add("stack_frame_match", _stack_frames, sql(r"""WITH f AS (SELECT id, CAST(pos - 1 AS INTEGER) AS pos, regexp_replace(replace(fr.file, '\', '/'), '^(\./)+', '') AS file, fr.line AS line, fr.function AS function FROM (SELECT id, unnest(event.error.frames[1:5]) AS fr, generate_subscripts(event.error.frames[1:5], 1) AS pos FROM observation WHERE event.error IS NOT NULL)),
    n AS (SELECT id, type, line, end_line, regexp_replace(replace(file, '\', '/'), '^(\./)+', '') AS file FROM nodes),
    a AS (SELECT f.id, f.pos, n.id AS around FROM f JOIN n ON (f.file = n.file OR ends_with(f.file, '/' || n.file) OR ends_with(n.file, '/' || f.file)) AND f.line BETWEEN n.line AND n.end_line QUALIFY row_number() OVER (PARTITION BY f.id, f.pos ORDER BY n.end_line - n.line, n.type NOT IN ('function', 'method'), n.id) = 1),
    u AS (SELECT name AS function, min(id) AS by_name FROM nodes WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
    SELECT f.id, f.pos, coalesce(around, by_name) AS node_id, CASE WHEN around IS NOT NULL THEN 'line' ELSE 'name' END AS via FROM f LEFT JOIN a USING (id, pos) LEFT JOIN u ON u.function = f.function WHERE coalesce(around, by_name) IS NOT NULL""", "nodes"))


def _resources(t):
    """(repository, resource): nations and the brands that their suppliers deliver."""
    supplied = t("lineitem").select("l_partkey", "l_suppkey").distinct().join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("resource")), "l_partkey")
    return supplied.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("repo")), "l_suppkey").select("repo", "resource").distinct()


_RESOURCES = "WITH r AS (SELECT DISTINCT s_nationkey AS repo, p_brand AS resource FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"


def _shared(t):
    r = _resources(t)
    # A resource is shared by at most as many repositories as there are nations (25), so its pairs stay few.
    groups = r.groupBy("resource").agg(F.array_sort(F.collect_set("repo")).alias("repos"))
    pairs = F.flatten(F.transform("repos", lambda a, i: F.transform(F.slice("repos", i + 2, F.size("repos")), lambda b: F.struct(a.alias("left_repo"), b.alias("right_repo")))))
    return groups.select(F.explode(pairs).alias("p")).groupBy("p.left_repo", "p.right_repo").agg(F.count("*").alias("shared"))


add("shared_resource_links", _shared, _RESOURCES + " SELECT a.repo AS left_repo, b.repo AS right_repo, count(*) AS shared FROM r a JOIN r b ON a.resource = b.resource AND a.repo < b.repo GROUP BY 1, 2")


def _providers(t):
    routes = v.observations(t).where("path is not null").select(fx.route_shape(F.col("path")).alias("shape"), "service_name").distinct()
    provided = routes.groupBy("shape").agg(F.count_distinct("service_name").alias("providers"), F.min("service_name").alias("first_provider"))
    return provided.withColumn("ambiguous", F.col("providers") > 1)


_SHAPE = r"'/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(path, '[?#].*', ''), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^(:|\{|\[|\*|<|\$)') OR regexp_matches(s, '^[0-9]+$') THEN '{}' ELSE lower(s) END), '/')"
add("api_links", _providers, sql(f"SELECT shape, count(DISTINCT service_name) AS providers, min(service_name) AS first_provider, count(DISTINCT service_name) > 1 AS ambiguous FROM (SELECT {_SHAPE} AS shape, service_name FROM obs WHERE path IS NOT NULL) GROUP BY shape", "obs"))


def _route_match(t):
    """Flow triggers against observed routes by the compatibility rule, blocked on the last literal segment."""
    flows = shredding.flow_objects(t("entry_point_flow"), {"trigger": "path_or_trigger", "method": "method"}).where("label = 'entry' and trigger like '/%'").select(fx.normal_route(F.col("trigger")).alias("entry_route")).distinct()
    seen = v.observations(t).where("path is not null").select(fx.normal_route(F.col("path")).alias("route")).distinct()
    last = lambda c: F.element_at(F.filter(fx.segments(c), lambda s: s != ":param"), -1)
    joined = flows.withColumn("block", last(F.col("entry_route"))).join(seen.withColumn("block", last(F.col("route"))), "block")
    return joined.where(fx.routes_compatible(F.col("entry_route"), F.col("route"))).select("entry_route", "route")


add("route_compatibility", _route_match)
add("shared_entities", lambda t: v.nodes(t).select(fx.entity_key(F.col("name")).alias("key"), "project_id").distinct().groupBy("key").agg(F.count("*").alias("projects")).where("projects > 1"), sql("SELECT key, count(*) AS projects FROM (SELECT DISTINCT regexp_replace(regexp_replace(lower(name), '^entity_', ''), '[^a-z0-9]', '', 'g') AS key, project_id FROM nodes) GROUP BY key HAVING count(*) > 1", "nodes"))


def _as_of(t):
    """For each instant at which a node was recorded the analysis that was the latest then, counted.

    A project's analyses are one small row, which its instants meet; no task orders all instants of a project.
    """
    snaps = t("analysis_entry").where("analyzed_at is not null").select("project_id", F.struct(F.col("analyzed_at").alias("at"), "analysis_id").alias("s")).distinct().groupBy("project_id").agg(F.collect_list("s").alias("snaps"))
    probes = t("cas_node").select("project_id", F.col("recorded_at").alias("at")).distinct()
    latest = F.array_max(F.filter("snaps", lambda s: s["at"] <= F.col("at")))["analysis_id"]
    return probes.join(snaps, "project_id", "left").groupBy("project_id", latest.alias("as_of")).agg(F.count("*").alias("n"))


add("as_of_snapshot", _as_of, """SELECT p.project_id, (SELECT arg_max(e.analysis_id, (e.analyzed_at, e.analysis_id)) FROM analysis_entry e WHERE e.project_id = p.project_id AND e.analyzed_at <= p.at) AS as_of, count(*) AS n
    FROM (SELECT DISTINCT project_id, recorded_at AS at FROM cas_node) p GROUP BY 1, 2""")
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
add("active_claims", lambda t: v.claims(t).where(f"heartbeat <= {_NOW}").groupBy("claim_id").agg(F.max_by(F.struct("status", "heartbeat", "ttl_ms", "path"), "seq").alias("c")).select("claim_id", "c.*").where(f"status = 'active' and unix_millis({_NOW}) - unix_millis(cast(heartbeat as timestamp)) <= ttl_ms").select("claim_id", "heartbeat", "path"),
    sql(f"SELECT claim_id, heartbeat, path FROM (SELECT * FROM claims WHERE heartbeat <= {_NOW} QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY seq DESC) = 1) WHERE status = 'active' AND epoch_ms({_NOW}) - epoch_ms(heartbeat) <= ttl_ms", "claims"))


def _collisions(t):
    last = v.claims(t).groupBy("claim_id").agg(F.max_by(F.struct("status", "path"), "seq").alias("c")).select("claim_id", "c.*").where("status = 'active'")
    # A path meets only claims of its own folder: pairs are found by every prefix of a path, not by comparing all.
    parts = fx.segments(F.col("path"))
    prefixes = last.select("claim_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))).alias("prefix"), "path")
    a = last.select(F.col("claim_id").alias("holder"), F.col("path").alias("prefix"))
    return a.join(prefixes, "prefix").where("holder <> claim_id").select(F.least("holder", "claim_id").alias("first_claim"), F.greatest("holder", "claim_id").alias("second_claim")).distinct().groupBy("first_claim").agg(F.count("*").alias("overlaps"))


add("path_overlaps", _collisions, sql("""WITH l AS (SELECT * FROM (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY seq DESC) = 1) WHERE status = 'active')
    SELECT a.claim_id AS first_claim, count(*) AS overlaps FROM l a JOIN l b ON a.claim_id < b.claim_id AND (a.path = b.path OR starts_with(a.path, b.path || '/') OR starts_with(b.path, a.path || '/')) GROUP BY 1""", "claims"))


def _tests_per_target(t, depth=12):
    """Test files that reach a target through calls and creations of up to ``depth`` steps."""
    pairs = durable(graph.pairs_of(v.edge_rows(t).where("type in ('calls', 'instantiates')")))
    tests = durable(v.nodes(t, "id", "file", "is_test").where("is_test").select("id", F.col("file").alias("test_file")))
    reached = graph.reach_per_seed(pairs, tests.select("id"), depth).where("depth > 0")
    return reached.join(tests.withColumnRenamed("id", "seed"), "seed").groupBy(F.col("id").alias("target")).agg(F.count_distinct("test_file").alias("test_files"), F.min("test_file").alias("first_file"))


_TESTS = """steps AS (SELECT DISTINCT source, target FROM cas_edge WHERE type IN ('calls', 'instantiates') AND target IS NOT NULL AND source <> target),
    walk(seed, id, depth) AS (SELECT id, id, 0 FROM nodes WHERE is_test UNION SELECT w.seed, s.target, w.depth + 1 FROM walk w JOIN steps s ON s.source = w.id WHERE w.depth < 12),
    tested AS (SELECT w.id AS target, count(DISTINCT n.file) AS test_files, min(n.file) AS first_file FROM (SELECT DISTINCT seed, id FROM walk WHERE id <> seed) w JOIN nodes n ON n.id = w.seed GROUP BY 1)"""
add("tests_of_target", _tests_per_target, sql(f"WITH {_TESTS} SELECT * FROM tested", "nodes", recursive=True))


def _accessors(t):
    way = F.when(F.col("type") == "uses", "read").when(F.col("type") == "instantiates", "write")
    e = v.edge_rows(t).where("target is not null").select("source", "target", "id", way.alias("way")).where("way is not null")
    return e.groupBy("target", "source").agg(F.min_by("way", "id").alias("first_way")).groupBy("target").pivot("first_way", ["read", "write"]).agg(F.count("source")).na.fill(0)


add("entity_accessors", _accessors, sql("SELECT target, count(*) FILTER (WHERE w = 'read') AS read, count(*) FILTER (WHERE w = 'write') AS write FROM (SELECT target, source, arg_min(CASE type WHEN 'uses' THEN 'read' ELSE 'write' END, id) AS w FROM edges WHERE target IS NOT NULL AND type IN ('uses', 'instantiates') GROUP BY 1, 2) GROUP BY target", "edges"))

# -- aggregations --------------------------------------------------------------
add("summary_counts", lambda t: v.nodes(t).groupBy("project_id").agg(F.count("*").alias("nodes"), F.count_distinct("type").alias("types"), F.count_distinct("file").alias("files"), F.count_if("is_test").alias("tests"), F.count_if("is_exported").alias("exported")), sql("SELECT project_id, count(*) AS nodes, count(DISTINCT type) AS types, count(DISTINCT file) AS files, count(*) FILTER (WHERE is_test) AS tests, count(*) FILTER (WHERE is_exported) AS exported FROM nodes GROUP BY 1", "nodes"))
add("fan_in_out", lambda t: v.edges(t, "source", "target", "type").where("type in ('calls', 'instantiates')").select(F.explode(F.array(F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).where("x.id is not null").groupBy("x.id").agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out")), sql("SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT target AS id, 1 AS i, 0 AS o FROM edges WHERE type IN ('calls', 'instantiates') AND target IS NOT NULL UNION ALL SELECT source, 0, 1 FROM edges WHERE type IN ('calls', 'instantiates')) GROUP BY id", "edges"))
add("reference_counts", lambda t: v.edge_rows(t).where("type <> 'contains' and target is not null and source <> target").groupBy("target").agg(F.count_distinct("source").alias("callers")), sql("SELECT target, count(DISTINCT source) AS callers FROM edges WHERE type <> 'contains' AND target IS NOT NULL AND source <> target GROUP BY 1", "edges"))
_RISK = "CASE risk WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END"


def _change_summary(key, key_sql):
    def build(t):
        files = v.commit_files(t).groupBy("commit_id").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("files"))
        c = v.commits(t).withColumn("key", key()).join(files, "commit_id", "left")
        return c.groupBy("key").agg(F.count("*").alias("changes"), F.sum("files").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.round(F.avg(F.expr(_RISK)), 6).alias("avg_risk"), F.max(F.expr(_RISK)).alias("max_risk"), F.count_if(F.col("risk") == "high").alias("high_risk"))

    return build, sql(f"""WITH f AS (SELECT commit_id, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, count(*) AS files FROM commit_files GROUP BY 1)
        SELECT {key_sql} AS key, count(*) AS changes, CAST(sum(files) AS BIGINT) AS files, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, round(avg({_RISK}), 6) AS avg_risk, max({_RISK}) AS max_risk, count(*) FILTER (WHERE risk = 'high') AS high_risk FROM commits LEFT JOIN f USING (commit_id) GROUP BY 1""", "commits", "commit_files")


add("change_summary_author", *_change_summary(lambda: F.col("author"), "author"))
add("change_summary_intent", *_change_summary(lambda: F.col("intent"), "intent"))
add("change_summary_day", *_change_summary(lambda: F.to_date("ts"), "CAST(ts AS DATE)"))
add("change_summary_week", *_change_summary(lambda: F.date_sub(F.to_date("ts"), F.dayofweek("ts") - 1), "CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS DATE)"))
add("change_summary_file", lambda t: v.commit_files(t).join(v.commits(t), "commit_id").groupBy("path").agg(F.count("*").alias("changes"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.max(F.expr(_RISK)).alias("max_risk")), sql(f"SELECT path, count(*) AS changes, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, max({_RISK}) AS max_risk FROM commit_files JOIN commits USING (commit_id) GROUP BY path", "commits", "commit_files"))
add("change_summary_module", lambda t: v.commit_files(t).groupBy("commit_id").agg(F.min("path").alias("p")).groupBy(F.substring_index("p", "/", 2).alias("module")).agg(F.count("*").alias("changes")), sql("SELECT string_split(p, '/')[1] || '/' || string_split(p, '/')[2] AS module, count(*) AS changes FROM (SELECT commit_id, min(path) AS p FROM commit_files GROUP BY 1) GROUP BY 1", "commit_files"))
add("file_churn", lambda t: history.file_churn(v.commits(t), v.commit_files(t)), sql("SELECT path, count(*) AS commits, count(DISTINCT author) AS authors, count(*) FILTER (WHERE intent = '1-URGENT') AS fixes, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM commits) - INTERVAL 30 DAY) AS last_30d, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM commits) - INTERVAL 90 DAY) AS last_90d, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM commit_files JOIN commits USING (commit_id) GROUP BY path", "commits", "commit_files"))
add("fix_percentile", lambda t: select.percentile_below(history.file_churn(v.commits(t), v.commit_files(t)).where("fixes > 0 or commits > 1").select("path", "fixes"), "fixes", "fix_percentile"), sql("WITH c AS (SELECT path, count(*) FILTER (WHERE intent = '1-URGENT') AS fixes, count(*) AS n FROM commit_files JOIN commits USING (commit_id) GROUP BY path) SELECT path, fixes, CAST(floor(100 * (rank() OVER (ORDER BY fixes) - 1) / count(*) OVER ()) AS INTEGER) AS fix_percentile FROM c WHERE fixes > 0 OR n > 1", "commits", "commit_files"))
_PAIRS = "WITH ok AS (SELECT commit_id FROM commit_files GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), pairs AS (SELECT a.path AS a, b.path AS b, count(*) AS together FROM commit_files a JOIN commit_files b ON a.commit_id = b.commit_id AND a.path < b.path WHERE a.commit_id IN (SELECT commit_id FROM ok) GROUP BY 1, 2 HAVING count(*) >= 2)"
add("co_change_pairs", lambda t: history.co_change(v.commit_files(t)), sql(_PAIRS + " SELECT a, b, together FROM pairs", "commit_files"))
add("co_change_index", lambda t: history.co_change_index(v.commit_files(t)), sql(_PAIRS + """, n AS (SELECT path, count(*) AS n FROM commit_files GROUP BY 1), total AS (SELECT count(DISTINCT commit_id) AS m FROM commit_files) , sides AS (SELECT a AS path, b AS partner, together FROM pairs UNION ALL SELECT b, a, together FROM pairs)
    SELECT sides.path, sides.partner, together AS support, round(together / x.n, 6) AS probability, round(together * (SELECT m FROM total)::DOUBLE / (x.n * y.n), 6) AS lift FROM sides JOIN n x ON x.path = sides.path JOIN n y ON y.path = sides.partner""", "commit_files"))


def _hot_spots(t):
    raw = v.commit_files(t).groupBy("path").agg(F.sum(F.col("added") + F.col("removed")).alias("raw"))
    scale = F.broadcast(raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")))  # one row
    scaled = raw.join(scale).withColumn("value", F.round((F.col("raw") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1), 6))
    return select.page(scaled.select("path", "raw", "value"), [F.col("raw").desc(), "path"], 20)


add("hot_spots", _hot_spots, sql("WITH r AS (SELECT path, CAST(sum(added + removed) AS BIGINT) AS raw FROM commit_files GROUP BY 1) SELECT path, raw, round((raw - (SELECT min(raw) FROM r)) / ((SELECT max(raw) FROM r) - (SELECT min(raw) FROM r))::DOUBLE, 6) AS value FROM r ORDER BY raw DESC, path LIMIT 20", "commit_files"))
add("project_health", lambda t: v.nodes(t, "project_id", "id").join(_tests_per_target(t).withColumnRenamed("target", "id"), "id", "left").groupBy("project_id").agg(F.count("*").alias("units"), F.count_if(F.col("test_files") > 0).alias("tested"), F.round(1 - F.count_if(F.col("test_files") > 0) / F.count("*"), 6).alias("untested_share")),
    sql(f"WITH {_TESTS} SELECT project_id, count(*) AS units, count(*) FILTER (WHERE test_files > 0) AS tested, round(1 - count(*) FILTER (WHERE test_files > 0) / count(*)::DOUBLE, 6) AS untested_share FROM nodes LEFT JOIN tested ON tested.target = nodes.id GROUP BY 1", "nodes", recursive=True))
add("conformance_shapes", lambda t: select.first_per_key(v.nodes(t).where("file is not null").select(F.coalesce(fx.language_of(F.col("file")), F.lit("?")).alias("language"), fx.naming_style(F.regexp_replace(fx.base_name(F.col("file")), r"\..*$", "")).alias("shape")).groupBy("language", "shape").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("language")), 6)), ["language"], [F.col("n").desc(), F.col("shape")]))
add("seam_inventory", lambda t: v.edges(t, "source", "target", "type").where("target is not null").withColumns({"a": F.substring_index("source", ":", 1), "b": F.substring_index("target", ":", 1)}).groupBy("a", "b").agg(F.count("*").alias("total"), F.concat_ws(",", F.array_sort(F.collect_set("type"))).alias("types")), sql("SELECT string_split(source, ':')[1] AS a, string_split(target, ':')[1] AS b, count(*) AS total, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM edges WHERE target IS NOT NULL GROUP BY 1, 2", "edges"))
_M = "coalesce(upper(trim(method)), '?')"
_FAILED = "coalesce(error_type is not null or status >= 500, false)"
_COUNTED = "duration_ms >= 0 and not isnan(duration_ms)"


def _route_metrics(t):
    by = ["method", "route"]
    o = v.observations(t).where("coalesce(route, path) is not null").select(F.expr(_M).alias("method"), F.coalesce("route", F.substring_index("path", "?", 1)).alias("route"), F.expr(f"case when {_COUNTED} then duration_ms end").alias("ms"), F.expr(_FAILED).alias("failed"))
    return ordered.with_percentiles(o, by, "ms", {"p50": 0.5, "p95": 0.95}, {"count": F.count("*"), "errors": F.count_if("failed"), "error_rate": F.round(F.count_if("failed") / F.count("*"), 3), "max": F.max("ms")})


add("route_metrics", _route_metrics,
    sql(f"SELECT {_M} AS method, coalesce(route, string_split(path, '?')[1]) AS route, count(*) AS count, count(*) FILTER (WHERE error_type IS NOT NULL OR status >= 500) AS errors, round(count(*) FILTER (WHERE error_type IS NOT NULL OR status >= 500) / count(*)::DOUBLE, 3) AS error_rate, quantile_disc(duration_ms, 0.5) FILTER (WHERE duration_ms >= 0 AND NOT isnan(duration_ms)) AS p50, quantile_disc(duration_ms, 0.95) FILTER (WHERE duration_ms >= 0 AND NOT isnan(duration_ms)) AS p95, max(duration_ms) FILTER (WHERE duration_ms >= 0 AND NOT isnan(duration_ms)) AS max FROM obs WHERE coalesce(route, path) IS NOT NULL GROUP BY 1, 2", "obs"))
add("status_histogram", lambda t: v.observations(t).where("status is not null").groupBy("service_name", "status").agg(F.count("*").alias("n")), sql("SELECT service_name, status, count(*) AS n FROM obs WHERE status IS NOT NULL GROUP BY 1, 2", "obs"))
_BAD = "coalesce(error_type is not null or status >= 500 or error_message <> '', false)"
_GOOD_D = "duration_ms > 0 and not isnan(duration_ms)"


def _impact(t, key):
    """Counts, sums and the exact 95th percentile of the durations of observations, per ``key`` (a column)."""
    o = v.observations(t).select(key.alias("key"), "trace_id", "recorded_at", "duration_ms", F.expr(_BAD).alias("bad"), F.expr(f"case when {_GOOD_D} then duration_ms end").alias("ms"))
    slow = F.count_if(F.expr("coalesce(duration_ms >= 1000 and not isnan(duration_ms), false)"))
    return ordered.with_percentiles(o, ["key"], "ms", {"p95": 0.95}, {"observations": F.count("*"), "errors": F.count_if("bad"), "slow": slow, "traces": F.count_distinct("trace_id"), "max_ms": F.max("ms"), "last_seen": F.max("recorded_at")})


_IMPACT = f"count(*) AS observations, count(*) FILTER (WHERE {_BAD}) AS errors, count(*) FILTER (WHERE duration_ms >= 1000 AND NOT isnan(duration_ms)) AS slow, count(DISTINCT trace_id) AS traces, quantile_disc(duration_ms, 0.95) FILTER (WHERE {_GOOD_D}) AS p95, max(duration_ms) FILTER (WHERE {_GOOD_D}) AS max_ms, max(recorded_at) AS last_seen"
add("impact_stats", lambda t: _impact(t, F.col("service_name")).withColumnRenamed("key", "service_name"), sql(f"SELECT service_name, {_IMPACT} FROM obs GROUP BY 1", "obs"))
add("node_runtime_metrics", lambda t: _impact(t, F.col("match_id")).withColumnRenamed("key", "match_id").where("match_id is not null"), sql(f"SELECT match_id, {_IMPACT} FROM obs WHERE match_id IS NOT NULL GROUP BY 1", "obs"))


def _priorities(t):
    """Targets by urgency. 18 per error, 8 per slow call, 12 per power of ten of events, 14 or 8 for error rates, 6 for a slow p95, 3 per trace; bands at 85, 60 and 30."""
    s = _impact(t, F.coalesce("match_id", "route", "path", F.lit("unmatched-runtime")))
    rate = F.col("errors") / F.col("observations")
    score = F.col("errors") * 18 + F.col("slow") * 8 + F.log10(F.col("observations").cast("double")) * 12 + F.when(rate >= 0.05, 14).when(rate >= 0.01, 8).otherwise(0) + F.when(F.col("p95") >= 1000, 6).otherwise(0) + F.col("traces") * 3
    s = s.withColumn("score", F.least(F.lit(100), fx.half_up(score)).cast("int"))
    severity = F.when((F.col("score") >= 85) | (F.col("errors") >= 5), "critical").when((F.col("score") >= 60) | (F.col("errors") >= 2), "high").when((F.col("score") >= 30) | (F.col("slow") > 0), "medium").otherwise("low")
    return s.select("key", "score", severity.alias("severity"))


add("operational_priorities", _priorities, sql(f"WITH s AS (SELECT coalesce(match_id, route, path, 'unmatched-runtime') AS key, {_IMPACT} FROM obs GROUP BY 1), x AS (SELECT *, CAST(least(100, floor(errors * 18 + slow * 8 + log10(observations) * 12 + CASE WHEN errors / observations::DOUBLE >= 0.05 THEN 14 WHEN errors / observations::DOUBLE >= 0.01 THEN 8 ELSE 0 END + CASE WHEN p95 >= 1000 THEN 6 ELSE 0 END + traces * 3 + 0.5)) AS INTEGER) AS score FROM s) SELECT key, score, CASE WHEN score >= 85 OR errors >= 5 THEN 'critical' WHEN score >= 60 OR errors >= 2 THEN 'high' WHEN score >= 30 OR slow > 0 THEN 'medium' ELSE 'low' END AS severity FROM x", "obs"))
add("dedupe_observations", lambda t: select.first_per_key(v.observations(t).select(F.coalesce("event_id", "id").alias("key"), "id", "recorded_at"), ["key"], [F.col("recorded_at"), F.col("id")]).select("key", "id"), sql("SELECT coalesce(event_id, id) AS key, id FROM obs QUALIFY row_number() OVER (PARTITION BY coalesce(event_id, id) ORDER BY recorded_at, id) = 1", "obs"))
add("unmatched_hints", lambda t: select.page(v.observations(t).where("coalesce(match_status, 'unmatched') = 'unmatched'").groupBy(F.coalesce(F.concat_ws(" ", F.nullif(F.upper(F.trim("method")), F.lit("")), F.nullif("route", F.lit(""))), F.lit("")).alias("hint")).agg(F.count("*").alias("n")), [F.col("n").desc(), "hint"], 10), sql("SELECT concat_ws(' ', nullif(upper(trim(method)), ''), nullif(route, '')) AS hint, count(*) AS n FROM obs WHERE coalesce(match_status, 'unmatched') = 'unmatched' GROUP BY 1 ORDER BY n DESC, hint LIMIT 10", "obs"))
add("unexercised_nodes", lambda t: v.nodes(t).where("type = 'function'").join(v.observations(t).select(F.col("match_id").alias("id")), "id", "left_anti").where(v.observations(t).agg(F.count("match_id")).scalar() > 0).groupBy("project_id").agg(F.count("*").alias("n")), sql("SELECT project_id, count(*) AS n FROM nodes WHERE type = 'function' AND NOT EXISTS (SELECT 1 FROM obs WHERE match_id = nodes.id) AND (SELECT count(match_id) FROM obs) > 0 GROUP BY 1", "nodes", "obs"))
add("flow_effects_rollup", lambda t: shredding.flow_effects(t("entry_point_flow")).groupBy("effect").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities")))
add("exposure_scores", lambda t: v.nodes(t).select("id", (F.when(F.col("category") == "data", 4).otherwise(0) + F.when(F.coalesce("is_exported", F.lit(False)), 2).otherwise(0) + F.when(F.size("throws") > 0, 1).otherwise(0)).alias("exposure")), sql("SELECT id, CASE WHEN category = 'data' THEN 4 ELSE 0 END + CASE WHEN coalesce(is_exported, false) THEN 2 ELSE 0 END + CASE WHEN len(throws) > 0 THEN 1 ELSE 0 END AS exposure FROM nodes", "nodes"))
add("delivery_metrics", lambda t: t("in_flight_diff_file").groupBy("workspace_id").agg(F.count("*").alias("files"), F.count_if(F.col("patch").isNotNull()).alias("patches"), F.count_distinct("agent_id").alias("agents"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at")), "SELECT workspace_id, count(*) AS files, count(patch) AS patches, count(DISTINCT agent_id) AS agents, min(captured_at) AS first_at, max(captured_at) AS last_at FROM in_flight_diff_file GROUP BY 1")
add("in_flight_latest", lambda t: select.first_per_key(t("in_flight_diff_file").where("agent_id is not null").select("agent_id", "diff_id", "captured_at"), ["agent_id"], [F.col("captured_at").desc(), F.col("diff_id").desc()]), "SELECT agent_id, diff_id, captured_at FROM in_flight_diff_file WHERE agent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY captured_at DESC, diff_id DESC) = 1")
add("trace_assembly", lambda t: v.observations(t).where("trace_id is not null").groupBy("trace_id").agg(F.count("*").alias("events"), F.count_distinct("service_name").alias("services"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at")), sql("SELECT trace_id, count(*) AS events, count(DISTINCT service_name) AS services, min(recorded_at) AS first_at, max(recorded_at) AS last_at FROM obs WHERE trace_id IS NOT NULL GROUP BY 1", "obs"))
