"""Queries of work in progress and its coordination, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.operators import coordination as co
from stratagraph.operators import select
from stratagraph.plans import views as v
from stratagraph.plans.views import SQL_VIEWS
from stratagraph.queries.registry import Registry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
add = _r.add


def _work(t):
    """Work of all workspaces as that on one system: agents meet across workspaces too."""
    return t("in_flight_diff_file").withColumnRenamed("diff_id", "seq").withColumn("workspace_id", F.lit("all"))


_WORK = "(SELECT * REPLACE ('all' AS workspace_id) FROM in_flight_diff_file) w"


_DECLARES = r"\b(?:def|function|func|fn|class|interface|struct|trait)\s+([A-Za-z_]\w*)"
_CLEAN = r"regexp_replace(replace(path, '\', '/'), '^(\./)+', '')"
_LINES = f"""lines AS (SELECT workspace_id, agent_id, {_CLEAN} AS path, unnest(string_split(patch, chr(10))) AS line FROM {_WORK} WHERE agent_id IS NOT NULL AND path IS NOT NULL AND patch IS NOT NULL),
changes AS (SELECT workspace_id, agent_id, path, symbol, CASE WHEN bool_or(s = '+') AND bool_or(s = '-') THEN 'changed' WHEN bool_or(s = '+') THEN 'added' ELSE 'removed' END AS change
  FROM (SELECT workspace_id, agent_id, path, line[1:1] AS s, regexp_extract(line, '{_DECLARES}', 1) AS symbol FROM lines WHERE (line LIKE '+%' AND line NOT LIKE '+++%') OR (line LIKE '-%' AND line NOT LIKE '---%')) WHERE symbol <> '' GROUP BY 1, 2, 3, 4)"""
_PLAN = """plan AS (SELECT workspace_id, symbol, count(DISTINCT agent_id) AS agents, CASE WHEN count(DISTINCT agent_id) = 1 THEN 'automatic' WHEN bool_and(change = 'added') THEN 'ordered' ELSE 'decision' END AS plan FROM changes GROUP BY 1, 2)"""

add("semantic_delta", lambda t: co.symbol_changes(_work(t)), f"WITH {_LINES} SELECT * FROM changes")
add("merge_plan", lambda t: co.merge_plan(co.symbol_changes(_work(t))), f"WITH {_LINES}, {_PLAN} SELECT * FROM plan")
add("merge_metrics", lambda t: co.merge_metrics(co.symbol_changes(_work(t))), f"WITH {_LINES}, {_PLAN} SELECT workspace_id, count(*) AS symbols, count(*) FILTER (WHERE plan = 'decision') AS decisions, round(count(*) FILTER (WHERE plan = 'decision') / greatest(1, count(*))::DOUBLE, 6) AS decision_rate FROM plan GROUP BY 1")
add(
    "arbitration",
    lambda t: co.arbitration(_work(t)),
    f"""WITH {_LINES}, agents AS (SELECT DISTINCT workspace_id, agent_id FROM {_WORK} WHERE agent_id IS NOT NULL),
    holds AS (SELECT DISTINCT workspace_id, agent_id, 1 AS o, 'path' AS kind, {_CLEAN} AS evidence FROM {_WORK} WHERE agent_id IS NOT NULL AND path IS NOT NULL UNION ALL SELECT DISTINCT workspace_id, agent_id, 2, 'symbol', symbol FROM changes),
    heads AS (SELECT *, min(agent_id) OVER g AS a, max(agent_id) OVER g AS z FROM holds WINDOW g AS (PARTITION BY workspace_id, kind, evidence)),
    best AS (SELECT workspace_id, agent_id, min((o, CASE WHEN agent_id = a THEN z ELSE a END, kind, evidence)) AS m FROM heads WHERE a <> z AND workspace_id IS NOT NULL GROUP BY 1, 2)
    SELECT a.workspace_id, a.agent_id, CASE WHEN m IS NULL THEN 'granted' ELSE 'conflict' END AS verdict, m[3] AS kind, m[2] AS partner, m[4] AS evidence FROM agents a LEFT JOIN best b ON b.workspace_id = a.workspace_id AND b.agent_id = a.agent_id""",
)
_CALLED = rf"""called AS (SELECT DISTINCT workspace_id, agent_id, unnest(regexp_extract_all(regexp_replace(line, '{_DECLARES}', '', 'g'), '\b([A-Za-z_]\w*)\(', 1)) AS symbol FROM (SELECT workspace_id, agent_id, unnest(string_split(patch, chr(10))) AS line FROM {_WORK} WHERE agent_id IS NOT NULL AND patch IS NOT NULL) WHERE line LIKE '+%' AND line NOT LIKE '+++%')"""
add(
    "conceptual_conflicts",
    lambda t: co.conceptual_conflicts(co.symbol_changes(_work(t)), co.added_calls(_work(t))),
    f"""WITH {_LINES}, {_CALLED}, turned AS (SELECT workspace_id, symbol, min(agent_id) AS f, max(agent_id) AS l FROM changes WHERE change <> 'added' GROUP BY 1, 2), users AS (SELECT workspace_id, symbol, min(agent_id) AS a, max(agent_id) AS z, count(DISTINCT agent_id) AS agents FROM called GROUP BY 1, 2)
    SELECT workspace_id, symbol, 'duplicate-work' AS kind, 'medium' AS severity, count(DISTINCT agent_id) AS agents FROM changes WHERE change = 'added' GROUP BY 1, 2 HAVING count(DISTINCT agent_id) > 1
    UNION ALL SELECT t.workspace_id, t.symbol, 'contract-divergence', 'high', agents FROM turned t JOIN users u ON u.workspace_id = t.workspace_id AND u.symbol = t.symbol WHERE f <> l OR a <> z OR f <> a""",
)


def _drift(t):
    n = v.nodes(t, "id", "project_id", "name", "is_exported")
    consumers = v.calls(t).join(n.select(F.col("id").alias("target"), "name").distinct(), "target").select("name", "source").distinct()
    return co.contract_drift(co.symbol_changes(_work(t)), n.where("is_exported"), consumers)


add(
    "contract_drift_of_work",
    _drift,
    f"""WITH nodes AS ({SQL_VIEWS['nodes']}), calls AS ({SQL_VIEWS['calls']}), {_LINES}, relied AS (SELECT name, count(*) AS consumers FROM (SELECT DISTINCT n.name, c.source FROM calls c JOIN (SELECT DISTINCT id, name FROM nodes) n ON n.id = c.target) GROUP BY 1)
    SELECT symbol AS name, agent_id, consumers, max(CASE change WHEN 'removed' THEN 'missing' ELSE 'drift' END) AS reason FROM changes JOIN relied r ON r.name = symbol WHERE change <> 'added' AND symbol IN (SELECT name FROM nodes WHERE is_exported) GROUP BY 1, 2, 3""",
)
add(
    "secret_files",
    lambda t: t("in_flight_diff_file").select("diff_id", co.drop_reason(F.col("path")).alias("reason")).where("reason is not null"),
    "SELECT diff_id, reason FROM (SELECT diff_id, CASE " + " ".join(f"WHEN regexp_matches(lower({_CLEAN}), '{p}') THEN '{r}'" for r, p in co.SECRET_PATHS) + " END AS reason FROM in_flight_diff_file) WHERE reason IS NOT NULL",
)
add("shown_files", lambda t: co.shown_files(t("in_flight_diff_file")).groupBy("workspace_id").agg(F.count("*").alias("files")), "SELECT workspace_id, count(*) AS files FROM in_flight_diff_file WHERE path IS NULL OR NOT (" + " OR ".join(f"regexp_matches(lower({_CLEAN}), '{p}')" for _, p in co.SECRET_PATHS) + ") GROUP BY 1")
add(
    "event_drain",
    lambda t: co.drained(_work(t)).where("later > 0"),
    f"SELECT workspace_id, agent_id, path, min(later) AS later FROM (SELECT workspace_id, agent_id, {_CLEAN} AS path, row_number() OVER (PARTITION BY workspace_id, {_CLEAN} ORDER BY diff_id DESC) - 1 AS later FROM {_WORK} WHERE path IS NOT NULL) WHERE agent_id IS NOT NULL GROUP BY 1, 2, 3 HAVING min(later) > 0",
)
_SINCE = "TIMESTAMP '2025-03-20 00:00:00'"
add(
    "impact_previews",
    lambda t: select.page(t("in_flight_diff_file").where(f"captured_at > {_SINCE}").select("diff_id", "captured_at", "path"), ["captured_at", "diff_id"], 20),
    f"SELECT diff_id, captured_at, path FROM in_flight_diff_file WHERE captured_at > {_SINCE} ORDER BY captured_at, diff_id LIMIT 20",
)


def _gaps(t, retained=0.5):
    """Cursors of users into the event log, of which the older half is compacted: whether each must read the whole state again."""
    log = v.claims(t)
    kept = log.agg((F.max("seq") * F.lit(retained)).cast("long")).scalar()
    return log.groupBy("claim_id").agg(F.max("seq").alias("cursor")).select("claim_id", "cursor", (F.col("cursor") < kept - 1).alias("gap"))


add("cursor_gaps", _gaps, f"WITH claims AS ({SQL_VIEWS['claims']}) SELECT claim_id, max(seq) AS cursor, max(seq) < (SELECT CAST(floor(max(seq) * 0.5) AS BIGINT) FROM claims) - 1 AS gap FROM claims GROUP BY 1")
