"""Queries of reachability, scopes, communities and module health, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.functions import text as fx
from stratagraph.operators import graph, reachability, select
from stratagraph.plans import views as v
from stratagraph.plans.views import with_views as sql
from stratagraph.queries.graphs import _HUBS, _SEEDS, _calls, _hubs, _seeds
from stratagraph.queries.registry import Registry
from stratagraph.session import durable

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
add = _r.add


def _asked(t, n=12):
    """Pairs of the n most calling and the n most called nodes, and an unknown one."""
    unknown = v.calls(t).limit(1).select(F.lit("?").alias("source"), F.lit("?").alias("target"))
    sources, targets = _seeds(t, n).select(F.col("id").alias("source"), F.lit(1).alias("k")), _hubs(t, n).select(F.col("id").alias("target"), F.lit(1).alias("k"))
    return sources.join(targets, "k").select("source", "target").unionByName(unknown)  # n rows a side


add(
    "can_reach",
    lambda t: reachability.can_reach(_calls(t), _asked(t)),
    sql(
        f"""WITH s AS ({_SEEDS[10:-1].replace("LIMIT 3", "LIMIT 12")}), h AS ({_HUBS[9:-1].replace("LIMIT 3", "LIMIT 12")}), walk(seed, id) AS (SELECT id, id FROM s UNION SELECT w.seed, c.target FROM walk w JOIN calls c ON c.source = w.id)
        SELECT s.id AS source, h.id AS target, EXISTS (SELECT 1 FROM walk w WHERE w.seed = s.id AND w.id = h.id) AS reaches FROM s, h UNION ALL SELECT '?', '?', true""",
        "calls",
        recursive=True,
    ),
)
add(
    "affected_components",
    lambda t: reachability.affected_components(_calls(t), _hubs(t)).select("id"),
    sql(f"WITH {_HUBS}, up(id) AS (SELECT id FROM hubs UNION SELECT c.source FROM up JOIN calls c ON c.target = up.id) SELECT id FROM up WHERE id NOT IN (SELECT id FROM hubs)", "calls", recursive=True),
)
add("affected_levels", lambda t: reachability.affected_components(_calls(t), _hubs(t), 3).groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("component").alias("components")))
add(
    "bounded_traversal",
    lambda t: reachability.bounded_walk(_calls(t), _seeds(t, 1), 3, 40),
    sql(
        """WITH s AS (SELECT source AS id FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), walk(id, depth) AS (SELECT id, 0 FROM s UNION SELECT c.target, w.depth + 1 FROM walk w JOIN calls c ON c.source = w.id WHERE w.depth < 3),
        least AS (SELECT id, min(depth) AS depth FROM walk GROUP BY 1) SELECT id, depth, (SELECT count(*) FROM least) > 40 AS truncated FROM least ORDER BY depth, id LIMIT 40""",
        "calls",
        recursive=True,
    ),
)


def _risk_scope(t):
    """What a change of the most called node touches: its neighbours, what contains it, and all that leads to it."""
    target = durable(_hubs(t, 1))
    pairs = durable(graph.pairs_of(v.edge_rows(t).where("type <> 'contains'")))
    near = graph.reach(durable(pairs.union(graph.turned(pairs)).distinct()), target, 1).where("depth = 1").select("id", F.lit("neighbour").alias("why"))
    above = graph.reach(v.nodes(t, "id", "parent").where("parent is not null and parent <> id").select(F.col("id").alias("source"), F.col("parent").alias("target")).distinct(), target).where("depth > 0").select("id", F.lit("container").alias("why"))
    up = graph.reach(graph.turned(_calls(t)), target).where("depth > 0").select("id", F.lit("upstream").alias("why"))
    return near.unionByName(above).unionByName(up)


add(
    "change_risk_scope",
    _risk_scope,
    sql(
        """WITH h AS (SELECT target AS id FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), e AS (SELECT DISTINCT source, target FROM edges WHERE type <> 'contains' AND target IS NOT NULL AND source <> target),
        p AS (SELECT DISTINCT id, parent FROM nodes WHERE parent IS NOT NULL AND parent <> id), above(id) AS (SELECT id FROM h UNION SELECT p.parent FROM above JOIN p USING (id)), up(id) AS (SELECT id FROM h UNION SELECT c.source FROM up JOIN calls c ON c.target = up.id)
        SELECT DISTINCT id, 'neighbour' AS why FROM (SELECT source AS id FROM e JOIN h ON h.id = e.target UNION SELECT target FROM e JOIN h ON h.id = e.source) WHERE id NOT IN (SELECT id FROM h)
        UNION ALL SELECT id, 'container' FROM above WHERE id NOT IN (SELECT id FROM h) UNION ALL SELECT id, 'upstream' FROM up WHERE id NOT IN (SELECT id FROM h)""",
        "calls",
        "edges",
        "nodes",
        recursive=True,
    ),
)


def _report(t):
    """Communities of calls, uses and dependencies with their size and the first 50 names of members (the report's bound)."""
    pairs = durable(graph.pairs_of(v.edge_rows(t).where("type in ('calls', 'uses', 'depends_on')")))
    members = graph.communities(pairs).join(v.nodes(t, "id", "name").groupBy("id").agg(F.min("name").alias("name")), "id", "left")
    first = select.top_per_key(members, ["community"], [F.col("name").asc_nulls_last(), F.col("id")], 50).groupBy("community").agg(F.concat_ws(", ", F.array_sort(F.collect_list("name"))).alias("names"))
    return members.groupBy("community").agg(F.count("*").alias("members")).join(first, "community")


add("community_report", _report)


def _component_parents(t):
    """The risk of a change of each class or function: its own, else that of what contains it, else 'unknown' (never low)."""
    n = v.nodes(t, "id", "type", "parent", "cyclomatic")
    own = F.when(F.col("cyclomatic") > 20, "critical").when(F.col("cyclomatic") > 10, "high").when(F.col("cyclomatic") > 5, "medium").when(F.col("cyclomatic").isNotNull(), "low")
    known = n.select("id", own.alias("risk")).groupBy("id").agg(F.max("risk").alias("risk"))
    chain = graph.ancestors(n.select("id", "parent")).join(known.where("risk is not null").withColumnsRenamed({"id": "ancestor", "risk": "above"}), "ancestor")
    nearest = chain.groupBy("id").agg(F.min(F.struct("distance", "ancestor", "above")).alias("n"))
    return known.join(nearest, "id", "left").select("id", F.coalesce("risk", "n.above", F.lit("unknown")).alias("risk"), F.when(F.col("risk").isNull(), F.col("n.ancestor")).alias("taken_from"))


add(
    "assessed_change_risk",
    _component_parents,
    sql(
        """WITH k AS (SELECT id, max(CASE WHEN cyclomatic > 20 THEN 'critical' WHEN cyclomatic > 10 THEN 'high' WHEN cyclomatic > 5 THEN 'medium' WHEN cyclomatic IS NOT NULL THEN 'low' END) AS risk FROM nodes GROUP BY 1),
        p AS (SELECT DISTINCT id, parent FROM nodes WHERE parent IS NOT NULL AND parent <> id), walk(id, ancestor, distance) AS (SELECT id, parent, 1 FROM p UNION SELECT w.id, p.parent, w.distance + 1 FROM walk w JOIN p ON p.id = w.ancestor WHERE p.parent <> w.id AND w.distance < 64),
        a AS (SELECT id, ancestor, min(distance) AS d FROM walk GROUP BY 1, 2), n AS (SELECT a.id, min((a.d, a.ancestor, k.risk)) AS s FROM a JOIN k ON k.id = a.ancestor WHERE k.risk IS NOT NULL GROUP BY 1)
        SELECT k.id, coalesce(k.risk, n.s[3], 'unknown') AS risk, CASE WHEN k.risk IS NULL THEN n.s[2] END AS taken_from FROM k LEFT JOIN n USING (id)""",
        "nodes",
        recursive=True,
    ),
)


def _modules(t):
    """Findings on folders with 10 files or more: outliers in size, in fan-in, in complexity and with several concerns."""
    n = v.nodes(t, "id", "project_id", "file", "category", "cyclomatic").where("file is not null")
    module = F.regexp_replace(fx.clean_path(F.col("file")), "/[^/]*$", "")
    per = n.withColumn("module", F.concat_ws(":", "project_id", F.substring_index(module, "/", 1)))
    inbound = v.edge_rows(t).where("target is not null and type = 'calls'").select(F.col("target").alias("id"), "source").distinct().groupBy("id").agg(F.count("*").alias("fan_in"))
    sums = per.join(inbound, "id", "left").groupBy("module").agg(F.count_distinct("file").alias("files"), F.count("*").alias("units"), F.count_distinct("category").alias("concerns"), F.sum(F.coalesce("fan_in", F.lit(0))).alias("fan_in"), F.max("cyclomatic").alias("worst"))
    findings = F.array_compact(F.array(F.when(F.col("units") > 60, F.lit("size-outlier")), F.when(F.col("fan_in") > 200, F.lit("fan-in-hotspot")), F.when(F.col("concerns") >= 4, F.lit("mixed-concerns")), F.when(F.col("worst") > 20, F.lit("danger-composite"))))
    return sums.where("files >= 10").select("module", "files", F.explode(findings).alias("kind"))


add(
    "module_health",
    _modules,
    sql(
        r"""WITH f AS (SELECT target AS id, count(DISTINCT source) AS fan_in FROM edges WHERE target IS NOT NULL AND type = 'calls' GROUP BY 1),
        p AS (SELECT n.project_id || ':' || string_split(regexp_replace(regexp_replace(replace(file, '\', '/'), '^(\./)+', ''), '/[^/]*$', ''), '/')[1] AS module, file, category, cyclomatic, coalesce(fan_in, 0) AS fan_in FROM nodes n LEFT JOIN f USING (id) WHERE file IS NOT NULL),
        s AS (SELECT module, count(DISTINCT file) AS files, count(*) AS units, count(DISTINCT category) AS concerns, sum(fan_in) AS fan_in, max(cyclomatic) AS worst FROM p GROUP BY 1 HAVING count(DISTINCT file) >= 10)
        SELECT module, files, 'size-outlier' AS kind FROM s WHERE units > 60 UNION ALL SELECT module, files, 'fan-in-hotspot' FROM s WHERE fan_in > 200 UNION ALL SELECT module, files, 'mixed-concerns' FROM s WHERE concerns >= 4 UNION ALL SELECT module, files, 'danger-composite' FROM s WHERE worst > 20""",
        "nodes",
        "edges",
    ),
)


def _adoption(t, least=5):
    """Naming paradigm of each type of unit and language: adoption of the style most of them have, and how many deviate."""
    style = fx.naming_style(F.col("name"))
    n = v.nodes(t, "name", "type", "file").where("name is not null and file is not null").select("type", F.coalesce(fx.language_of(F.col("file")), F.lit("?")).alias("language"), style.alias("style"))
    counts = n.groupBy("type", "language", "style").agg(F.count("*").alias("n"))
    total = counts.groupBy("type", "language").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    first = select.first_per_key(counts, ["type", "language"], [F.col("n").desc(), F.col("style")])
    return first.join(total, ["type", "language"]).select("type", "language", "style", F.round(F.col("n") / F.col("total"), 4).alias("adoption"), (F.col("total") - F.col("n")).alias("deviations"), "total")


_STYLE = "CASE WHEN regexp_full_match(name, '[a-z]+(?:[A-Z][a-z0-9]*)+') THEN 'camel' WHEN regexp_full_match(name, '(?:[A-Z][a-z0-9]*)+') THEN 'pascal' WHEN regexp_full_match(name, '[a-z0-9]+(?:_[a-z0-9]+)+') THEN 'snake' WHEN regexp_full_match(name, '[a-z0-9]+(?:-[a-z0-9]+)+') THEN 'kebab' ELSE 'other' END"
_LANGUAGE = r"coalesce(map_extract(MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in fx.LANGUAGES.items()) + r"}, lower(regexp_extract(file, '\.([A-Za-z0-9]+)$', 1)))[1], '?')"
_ADOPTION = f"""c AS (SELECT type, {_LANGUAGE} AS language, {_STYLE} AS style, count(*) AS n FROM nodes WHERE name IS NOT NULL AND file IS NOT NULL GROUP BY ALL),
    adopted AS (SELECT type, language, style, round(n / total::DOUBLE, 4) AS adoption, CAST(total - n AS BIGINT) AS deviations, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY type, language) AS total, row_number() OVER (PARTITION BY type, language ORDER BY n DESC, style) AS r FROM c) WHERE r = 1 AND total >= 5)"""
add("paradigm_conformance", _adoption, sql(f"WITH {_ADOPTION} SELECT * FROM adopted", "nodes"))
add(
    "idioms_of_conformance",
    lambda t: select.page(_adoption(t).where("total >= 10 and adoption >= 0.6").select("type", "language", "style", "adoption", F.when(F.col("adoption") >= 0.9, "strong").otherwise("common").alias("strength"), "deviations"), [F.col("adoption").desc(), "type", "language"], 8),
    sql(f"WITH {_ADOPTION} SELECT type, language, style, adoption, CASE WHEN adoption >= 0.9 THEN 'strong' ELSE 'common' END AS strength, deviations FROM adopted WHERE total >= 10 AND adoption >= 0.6 ORDER BY adoption DESC, type, language LIMIT 8", "nodes"),
)
add(
    "invariants_of_evidence",
    lambda t: _adoption(t).where("adoption = 1").select(F.concat_ws(" ", F.lit("every"), "language", "type", F.lit("is named in"), "style").alias("invariant"), F.col("total").alias("evidence")),
    sql(f"WITH {_ADOPTION} SELECT concat_ws(' ', 'every', language, type, 'is named in', style) AS invariant, total AS evidence FROM adopted WHERE adoption = 1", "nodes"),
)

#: A convention is a name, the files it is for and what their units' names must look like.
CONVENTIONS = [("hooks", "%.ts", "^[a-z]"), ("modules", "%.py", "^[a-zA-Z][A-Za-z0-9_]*$"), ("types", "%.go", "^[A-Z]")]


def _conventions(t, rules=None):
    """How far user-given conventions (name, file pattern, name pattern) hold: units looked at, matching and not."""
    table = t.spark.createDataFrame(rules or CONVENTIONS, "convention string, files string, pattern string")
    n = v.nodes(t, "name", "file").where("name is not null and file is not null")
    met = n.join(F.broadcast(table), F.expr("file like files"))  # as many rows as the user gave rules
    return met.groupBy("convention").agg(F.count("*").alias("units"), F.count_if(F.expr("regexp_like(name, pattern)")).alias("matching"), F.count_if(F.expr("not regexp_like(name, pattern)")).alias("deviating"))


add(
    "custom_conventions",
    _conventions,
    sql("WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in CONVENTIONS) + ") AS r(convention, files, pattern)) SELECT convention, count(*) AS units, count(*) FILTER (WHERE regexp_matches(name, pattern)) AS matching, count(*) FILTER (WHERE NOT regexp_matches(name, pattern)) AS deviating FROM nodes JOIN r ON file LIKE files WHERE name IS NOT NULL AND file IS NOT NULL GROUP BY 1", "nodes"),
)


def _conflicts(t):
    """Calls against the order of layers, by severity: two layers up is high, one is medium; with the number of callers."""
    rank = F.create_map(*(F.lit(x) for p in {"presentation": 0, "transport": 1, "domain": 2, "storage": 3}.items() for x in p))
    n = v.nodes(t, "id", "category", "is_test").where("not coalesce(is_test, false)").groupBy("id").agg(F.max("category").alias("category")).select("id", rank[F.col("category")].alias("layer")).where("layer is not null")
    e = v.calls(t).join(n.withColumnsRenamed({"id": "source", "layer": "a"}), "source").join(n.withColumnsRenamed({"id": "target", "layer": "b"}), "target").where("b < a")
    return e.groupBy("target", (F.when(F.col("a") - F.col("b") >= 2, "high").otherwise("medium")).alias("severity")).agg(F.count("*").alias("callers"))


add(
    "architectural_conflicts",
    _conflicts,
    sql(
        """WITH n AS (SELECT id, MAP {'presentation': 0, 'transport': 1, 'domain': 2, 'storage': 3}[max(category)] AS layer FROM nodes WHERE NOT coalesce(is_test, false) GROUP BY 1)
        SELECT target, CASE WHEN a.layer - b.layer >= 2 THEN 'high' ELSE 'medium' END AS severity, count(*) AS callers FROM calls c JOIN n a ON a.id = c.source JOIN n b ON b.id = c.target WHERE b.layer < a.layer GROUP BY 1, 2""",
        "calls",
        "nodes",
    ),
)


def _context(t):
    """Each function beside what one needs to change it: callers, callees, tests that call it, siblings in its file."""
    n = v.nodes(t, "id", "name", "file", "type", "is_test").where("type in ('function', 'method')")
    c = v.calls(t)
    callers = c.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("callers"))
    callees = c.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("callees"))
    tests = c.join(n.where("is_test").select(F.col("id").alias("source")).distinct(), "source", "left_semi").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("tests"))
    siblings = n.where("file is not null").groupBy("file").agg((F.count("*") - 1).alias("siblings"))
    out = n.select("id", "name", "file")
    for df, on in ((callers, "id"), (callees, "id"), (tests, "id"), (siblings, "file")):
        out = out.join(df, on, "left")
    return out.select("id", "name", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("callers", "callees", "tests", "siblings")))


_CONTEXT = """n AS (SELECT id, name, file, is_test FROM nodes WHERE type IN ('function', 'method')), f AS (SELECT file, count(*) - 1 AS siblings FROM n WHERE file IS NOT NULL GROUP BY 1),
    context AS (SELECT n.id, n.name, coalesce(a.k, 0) AS callers, coalesce(b.k, 0) AS callees, coalesce(x.k, 0) AS tests, coalesce(siblings, 0) AS siblings FROM n LEFT JOIN (SELECT target AS id, count(*) AS k FROM calls GROUP BY 1) a ON a.id = n.id LEFT JOIN (SELECT source AS id, count(*) AS k FROM calls GROUP BY 1) b ON b.id = n.id
      LEFT JOIN (SELECT target AS id, count(*) AS k FROM calls WHERE source IN (SELECT id FROM n WHERE is_test) GROUP BY 1) x ON x.id = n.id LEFT JOIN f ON f.file = n.file)"""
add("coding_context", _context, sql(f"WITH {_CONTEXT} SELECT * FROM context", "nodes", "calls"))


def _guide(t):
    """What a change of a signature asks for: callers to change, tests to run, and whether it goes step by step."""
    steps = F.when(F.col("callers") > 20, "deprecate first").when(F.col("callers") > 0, "change callers").otherwise("change freely")
    return _context(t).select("id", steps.alias("way"), "callers", "tests", ((F.col("callers") > 0) & (F.col("tests") == 0)).alias("write_tests_first"))


add("modification_guide", _guide, sql(f"WITH {_CONTEXT} SELECT id, CASE WHEN callers > 20 THEN 'deprecate first' WHEN callers > 0 THEN 'change callers' ELSE 'change freely' END AS way, callers, tests, callers > 0 AND tests = 0 AS write_tests_first FROM context", "nodes", "calls"))


def _by_tag(tag):
    return lambda t: v.nodes(t, "id", "project_id", "name", "type", "tags").where(F.array_contains("tags", tag)).select("id", "project_id", "name", "type").distinct()


for _name, _tag in (("lifecycle_hooks", "entry"), ("behaviours", "batch"), ("public_units", "public")):
    add(_name, _by_tag(_tag), sql(f"SELECT DISTINCT id, project_id, name, type FROM nodes WHERE list_contains(tags, '{_tag}')", "nodes"))
add("data_entities", lambda t: v.nodes(t, "type", "category").where("type in ('class', 'interface')").groupBy(F.coalesce("category", F.lit("unknown")).alias("role")).agg(F.count("*").alias("n")), sql("SELECT coalesce(category, 'unknown') AS role, count(*) AS n FROM nodes WHERE type IN ('class', 'interface') GROUP BY 1", "nodes"))
add("domain_concepts", lambda t: v.nodes(t, "name").where("name is not null").select(F.explode(fx.search_tokens(F.col("name"))).alias("concept")).groupBy("concept").agg(F.count("*").alias("mentions")).where("mentions >= 5"), sql("SELECT concept, count(*) AS mentions FROM (SELECT unnest(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-./]', ' ', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) AS concept FROM nodes WHERE name IS NOT NULL) GROUP BY 1 HAVING count(*) >= 5", "nodes"))


def _entity_roles(t):
    """'core' for classes that several projects' units or 5 callers use, 'supporting' for used ones, else 'infrastructure'."""
    used = v.edge_rows(t).where("target is not null and source <> target").groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("users"))
    n = v.nodes(t, "id", "type").where("type in ('class', 'interface')").select("id").distinct()
    return n.join(used, "id", "left").select("id", F.when(F.col("users") >= 5, "core").when(F.col("users") > 0, "supporting").otherwise("infrastructure").alias("role"))


add("entity_roles", _entity_roles, sql("SELECT n.id, CASE WHEN users >= 5 THEN 'core' WHEN users > 0 THEN 'supporting' ELSE 'infrastructure' END AS role FROM (SELECT DISTINCT id FROM nodes WHERE type IN ('class', 'interface')) n LEFT JOIN (SELECT target AS id, count(DISTINCT source) AS users FROM edges WHERE target IS NOT NULL AND source <> target GROUP BY 1) USING (id)", "nodes", "edges"))
add("intents", lambda t: v.nodes(t, "id", "description").where("trim(description) <> ''").select("id", F.regexp_extract(F.trim("description"), r"^([A-Za-z]+)", 1).alias("verb")).distinct(), sql("SELECT DISTINCT id, regexp_extract(trim(description), '^([A-Za-z]+)', 1) AS verb FROM nodes WHERE trim(description) <> ''", "nodes"))


def _ship_weights(t):
    """Weight of each project: its share of exported units times its share of recent changes, kept within 0.05 and 1."""
    n = v.nodes(t, "project_id", "is_exported").groupBy("project_id").agg((F.count_if("is_exported") / F.count("*")).alias("ship"))
    days = t("cas_node").groupBy("project_id").agg(F.max("snapshot_no").alias("last"))
    return n.join(days, "project_id").select("project_id", F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("ship") * F.col("last") / 5)), 3).alias("weight"))


add("ship_activity_weights", _ship_weights, sql("SELECT project_id, round(greatest(0.05, least(1.0, ship * last / 5)), 3) AS weight FROM (SELECT project_id, count(*) FILTER (WHERE is_exported) / count(*)::DOUBLE AS ship FROM nodes GROUP BY 1) JOIN (SELECT project_id, max(snapshot_no) AS last FROM cas_node GROUP BY 1) USING (project_id)", "nodes"))
