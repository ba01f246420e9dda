"""Queries of derived views: drift, stability, telemetry roll-ups, conventions, contention and near copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.functions import text as fx
from stratagraph.operators import history, select, shredding, similar
from stratagraph.plans import views as v
from stratagraph.plans.views import with_views as sql
from stratagraph.queries.registry import Registry
from stratagraph.streaming import telemetry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
add = _r.add

add("history_page", lambda t: select.page(v.commits(t).where("ts >= timestamp_ntz '1998-01-01' and ts < timestamp_ntz '1999-01-01'"), [F.col("ts").desc(), "commit_id"], 100), sql("SELECT * FROM commits WHERE ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '1999-01-01' ORDER BY ts DESC, commit_id LIMIT 100", "commits"))


def _stability(t):
    c = history.file_churn(v.commits(t), v.commit_files(t))
    rate = F.col("fixes") / F.col("commits")
    return c.select("path", F.round(rate, 6).alias("bug_fix_rate"), F.when((F.col("commits") >= 40) & (rate > 0.3), "volatile").when(rate > 0.3, "fragile").when(F.col("last_90d") == 0, "settled").otherwise("stable").alias("stability"))


add("file_stability", _stability, sql("WITH c AS (SELECT path, count(*) AS n, count(*) FILTER (WHERE intent = '1-URGENT') AS fixes, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM commits) - INTERVAL 90 DAY) AS l FROM commit_files JOIN commits USING (commit_id) GROUP BY path) SELECT path, round(fixes / n::DOUBLE, 6) AS bug_fix_rate, CASE WHEN n >= 40 AND fixes / n::DOUBLE > 0.3 THEN 'volatile' WHEN fixes / n::DOUBLE > 0.3 THEN 'fragile' WHEN l = 0 THEN 'settled' ELSE 'stable' END AS stability FROM c", "commits", "commit_files"))


def _change_risk(t):
    callers = v.calls(t).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("callers"))
    n = v.nodes(t).select("id", "cyclomatic", "is_exported", "category", "throws").join(callers, "id", "left")
    calls = F.coalesce("callers", F.lit(0))
    factor = lambda c, severity: F.when(c, severity)
    severities = F.filter(F.array(factor(calls > 10, "high"), factor((calls > 5) & (calls <= 10), "medium"), factor(F.col("cyclomatic") > 20, "high"), factor((F.col("cyclomatic") > 10) & (F.col("cyclomatic") <= 20), "medium"), factor(F.coalesce("is_exported", F.lit(False)), "medium"), factor(F.col("category") == "data", "medium")), lambda x: x.isNotNull())
    high = F.size(F.filter(severities, lambda x: x == "high"))
    level = F.when(high >= 2, "critical").when(high == 1, "high").when(F.size(severities) >= 2, "medium").otherwise("low")
    return n.select("id", level.alias("risk_level"), F.size(severities).alias("factors"))


add("change_risk", _change_risk, sql("""WITH x AS (SELECT n.id, coalesce(c.k, 0) AS k, cyclomatic AS y, coalesce(is_exported, false) AS e, category FROM nodes n LEFT JOIN (SELECT target, count(*) AS k FROM calls GROUP BY 1) c ON c.target = n.id),
    f AS (SELECT id, CAST(k > 10 AS INTEGER) + CAST(coalesce(y > 20, false) AS INTEGER) AS h, CAST(k > 5 AND k <= 10 AS INTEGER) + CAST(coalesce(y > 10 AND y <= 20, false) AS INTEGER) + CAST(e AS INTEGER) + CAST(coalesce(category = 'data', false) AS INTEGER) AS m FROM x)
    SELECT id, CASE WHEN h >= 2 THEN 'critical' WHEN h = 1 THEN 'high' WHEN h + m >= 2 THEN 'medium' ELSE 'low' END AS risk_level, h + m AS factors FROM f""", "nodes", "calls"))
add("telemetry_fusion", lambda t: v.observations(t).where("match_id is not null").withColumn("fact", F.when(F.expr("coalesce(error_type is not null or status >= 500, false)"), "error").when(F.expr("duration_ms >= 1000 and not isnan(duration_ms)"), "slow").otherwise("hot")).groupBy("match_id", "fact", "service_name").agg(F.max_by("id", F.struct("recorded_at", "id")).alias("last_id"), F.count("*").alias("n")),
    sql("SELECT match_id, fact, service_name, arg_max(id, (recorded_at, id)) AS last_id, count(*) AS n FROM (SELECT *, CASE WHEN coalesce(error_type IS NOT NULL OR status >= 500, false) THEN 'error' WHEN duration_ms >= 1000 AND NOT isnan(duration_ms) THEN 'slow' ELSE 'hot' END AS fact FROM obs WHERE match_id IS NOT NULL) GROUP BY 1, 2, 3", "obs"))


add("matched_targets", lambda t: select.page(v.observations(t).where("match_id is not null").groupBy("match_id").agg(F.count_if(F.expr("coalesce(error_type is not null or status >= 500, false)")).alias("errors"), F.count("*").alias("volume")), [F.col("errors").desc(), F.col("volume").desc(), "match_id"], 50), sql("SELECT match_id, count(*) FILTER (WHERE coalesce(error_type IS NOT NULL OR status >= 500, false)) AS errors, count(*) AS volume FROM obs WHERE match_id IS NOT NULL GROUP BY 1 ORDER BY errors DESC, volume DESC, match_id LIMIT 50", "obs"))


def _semantic_coverage(t):
    steps = shredding.flow_steps(t("entry_point_flow")).where("node_id is not null").select(F.col("node_id").alias("id")).distinct().withColumn("mapped", F.lit(1))
    return v.nodes(t).select("id", "project_id").join(steps, "id", "left").groupBy("project_id").agg(F.count("*").alias("nodes"), F.count("mapped").alias("mapped"))


add("semantic_coverage", _semantic_coverage)
add("idioms", lambda t: select.first_per_key(v.nodes(t).groupBy("type", fx.naming_style(F.col("name")).alias("style")).agg(F.count("*").alias("support"), F.min("id").alias("example")), ["type"], [F.col("support").desc(), F.col("style")]), sql("SELECT type, style, count(*) AS support, min(id) AS example FROM (SELECT id, type, CASE WHEN regexp_matches(name, '^[a-z]+(?:[A-Z][a-z0-9]*)+$') THEN 'camel' WHEN regexp_matches(name, '^(?:[A-Z][a-z0-9]*)+$') THEN 'pascal' WHEN regexp_matches(name, '^[a-z0-9]+(?:_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(name, '^[a-z0-9]+(?:-[a-z0-9]+)+$') THEN 'kebab' ELSE 'other' END AS style FROM nodes) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, style) = 1", "nodes"))
add("link_coverage", lambda t: v.edges(t, "project_id", "target").groupBy("project_id").agg(F.count("*").alias("detected"), F.count("target").alias("linked"), F.count_if(F.col("target").isNull()).alias("unlinked")), sql("SELECT project_id, count(*) AS detected, count(target) AS linked, count(*) FILTER (WHERE target IS NULL) AS unlinked FROM edges GROUP BY 1", "edges"))
_CLEAN = r"regexp_replace(replace(path, '\', '/'), '^(\./)+', '')"
add("contended_paths", lambda t: t("in_flight_diff_file").where("agent_id is not null and path is not null").groupBy(fx.clean_path(F.col("path")).alias("path")).agg(F.count_distinct("agent_id").alias("agents"), F.min("agent_id").alias("first_agent"), F.max("captured_at").alias("last_at")).where("agents > 1"), f"SELECT {_CLEAN} AS path, count(DISTINCT agent_id) AS agents, min(agent_id) AS first_agent, max(captured_at) AS last_at FROM in_flight_diff_file WHERE agent_id IS NOT NULL AND path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT agent_id) > 1")
add("bug_fix_subjects", lambda t: t("documents").where("source = 'commit_log' and text is not null").groupBy(F.lower(F.substring_index("text", "\n", 1)).rlike(r"^(fix|bug|hotfix)\b|\b(fixes|bug)\b").alias("is_fix")).agg(F.count("*").alias("n")), r"SELECT regexp_matches(lower(string_split(text, chr(10))[1]), '^(fix|bug|hotfix)\b|\b(fixes|bug)\b') AS is_fix, count(*) AS n FROM documents WHERE source = 'commit_log' AND text IS NOT NULL GROUP BY 1")
_WORDS_OF = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace(string_split_regex(name, '[.:]')[-1], 'Async$', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[ _!?-]+'), lambda w: w <> '')"


def _effect_sql() -> str:
    cases = []
    for stage, rules in fx.EFFECT_WORDS.items():
        for does, listed in rules.items():
            known = ", ".join(f"'{w}'" for w in listed.split())
            fits = f"array_to_string(w, '') IN ({known})" if stage == "whole" else f"w[1] IN ({known})" if stage == "first" else f"len(list_intersect(w, [{known}])) > 0"
            cases.append(f"WHEN {fits} THEN '{does}'")
    return f"SELECT CASE {' '.join(cases)} ELSE 'read' END AS effect, count(*) AS n FROM (SELECT {_WORDS_OF} AS w FROM nodes WHERE name IS NOT NULL) GROUP BY 1"


add("effect_verbs", lambda t: v.nodes(t, "id", "name").where("name is not null").groupBy(fx.effect_of(F.col("name")).alias("effect")).agg(F.count("*").alias("n")), sql(_effect_sql(), "nodes"))


def _route_drift(t):
    """Triggers of flows without a compatible observed route, with the nearest one of equal length by shared segments."""
    flows = shredding.flow_objects(t("entry_point_flow"), {"trigger": "path_or_trigger"}).where("label = 'entry' and trigger like '/%'").select(fx.normal_route(F.col("trigger")).alias("entry_route")).distinct()
    seen = v.observations(t).where("path is not null").select(fx.normal_route(F.col("path")).alias("route")).distinct()
    parts = lambda c: F.filter(fx.segments(c), lambda s: s != ":param")
    near = flows.withColumn("part", F.explode(parts(F.col("entry_route")))).join(seen.withColumn("part", F.explode(parts(F.col("route")))), "part").groupBy("entry_route", "route").agg(F.count_distinct("part").alias("shared"))
    scored = near.withColumn("similarity", F.round(F.col("shared") / F.greatest(F.size(fx.segments(F.col("entry_route"))), F.size(fx.segments(F.col("route")))), 6))
    compatible = scored.where(fx.routes_compatible(F.col("entry_route"), F.col("route"))).select("entry_route").distinct()
    best = scored.groupBy("entry_route").agg(F.max(F.struct("similarity", "route")).alias("b"))
    return flows.join(compatible, "entry_route", "left_anti").join(best, "entry_route", "left").select("entry_route", F.col("b.route").alias("nearest"), F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"), F.when(F.col("b.similarity") >= 0.7, "near-miss").otherwise("missing").alias("kind"))


add("route_drift", _route_drift)
add("field_drift", lambda t: t("cas_node").select("project_id", "snapshot_no", "id", F.explode("signature.parameters").alias("p")).select("project_id", "snapshot_no", "id", F.col("p.name").alias("field"), F.col("p.type").alias("type")).distinct().groupBy("project_id", "id", "field").agg(F.count_distinct("type").alias("types")).where("types > 1"), "SELECT project_id, id, p.name AS field, count(DISTINCT p.type) AS types FROM (SELECT project_id, id, unnest(signature.parameters) AS p FROM cas_node) GROUP BY 1, 2, 3 HAVING count(DISTINCT p.type) > 1")
add("near_copies", lambda t: similar.similar_classes(t("documents"), "doc_id", "text"))
add("er_diagram", lambda t: v.edge_rows(t).where("type = 'depends_on' and target is not null").select("source", "target").distinct().groupBy("source").agg(F.concat_ws(", ", F.array_sort(F.collect_list("target"))).alias("relations")), sql("SELECT source, string_agg(target, ', ' ORDER BY target) AS relations FROM (SELECT DISTINCT source, target FROM edges WHERE type = 'depends_on' AND target IS NOT NULL) GROUP BY 1", "edges"))
add("project_markdown", lambda t: v.nodes(t).groupBy("project_id", "type").agg(F.count("*").alias("n")).groupBy("project_id").agg(F.concat(F.lit("# "), F.col("project_id"), F.lit("\n"), F.concat_ws("\n", F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("type"), F.lit(": "), F.col("n").cast("string")))))).alias("markdown")), sql("SELECT project_id, '# ' || project_id || chr(10) || string_agg('- ' || type || ': ' || n, chr(10) ORDER BY '- ' || type || ': ' || n) AS markdown FROM (SELECT project_id, type, count(*) AS n FROM nodes GROUP BY 1, 2) GROUP BY 1", "nodes"))
add("system_overview", lambda t: t("analysis_entry").distinct().groupBy("system_type").agg(F.count_distinct("project_id").alias("projects"), F.max("node_count").alias("largest"), F.sum("edge_count").alias("edges")), "SELECT system_type, count(DISTINCT project_id) AS projects, max(node_count) AS largest, CAST(sum(edge_count) AS BIGINT) AS edges FROM (SELECT DISTINCT * FROM analysis_entry) GROUP BY 1")
add("framework_counts", lambda t: t("analysis_entry").select("project_id", F.explode("frameworks").alias("framework")).distinct().groupBy("framework").agg(F.count("*").alias("projects")), "SELECT framework, count(*) AS projects FROM (SELECT DISTINCT project_id, unnest(frameworks) AS framework FROM analysis_entry) GROUP BY 1")
add("in_flight_bursts", lambda t: telemetry.bursts(t("in_flight_diff_file").where("agent_id is not null"), "agent_id", "captured_at", "1 hour").groupBy("agent_id").agg(F.count("*").alias("bursts"), F.max("changes").alias("largest")), """WITH x AS (SELECT agent_id, captured_at, CASE WHEN captured_at - lag(captured_at) OVER (PARTITION BY agent_id ORDER BY captured_at) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM in_flight_diff_file WHERE agent_id IS NOT NULL),
    y AS (SELECT agent_id, sum(fresh) OVER (PARTITION BY agent_id ORDER BY captured_at RANGE UNBOUNDED PRECEDING) AS b FROM x), z AS (SELECT agent_id, b, count(*) AS n FROM y GROUP BY 1, 2) SELECT agent_id, count(*) AS bursts, max(n) AS largest FROM z GROUP BY 1""")
