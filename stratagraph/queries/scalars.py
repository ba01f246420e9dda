"""Queries of scalar functions over whole columns and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.functions import text as fx
from stratagraph.plans import views as v
from stratagraph.plans.views import with_views as sql
from stratagraph.queries.registry import Registry

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
add = _r.add


def _paths(t):
    return v.observations(t).where("path is not null").select("path").distinct()


# DuckDB's expressions have no look-around, so a segment is named with the slash before and after it.
add(
    "service_routes",
    lambda t: _paths(t).select("path", fx.service_route(F.col("path")).alias("route")),
    sql(
        r"""WITH p AS (SELECT DISTINCT path, regexp_replace(regexp_replace(lower(path), '^https?://[^/]+', ''), '\?.*$', '') AS bare FROM obs WHERE path IS NOT NULL),
        s AS (SELECT path, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(bare, '\$\{[^}]*\}', ':param', 'g'), '/'),
            lambda x: CASE WHEN regexp_full_match(x, ':[^/]+|\{[^/]+\}|\*') THEN ':param' ELSE x END), '/'), '/{2,}', '/', 'g'), '/$', '') AS short FROM p)
        SELECT path, CASE WHEN short = '' THEN '/' ELSE short END AS route FROM s""",
        "obs",
    ),
)


def _guards(t):
    nodes = v.nodes(t, "name").select(F.lower("name").alias("name"))
    return nodes.distinct().select("name", fx.guard_kind(F.col("name")).alias("kind"))


add(
    "guard_kinds",
    _guards,
    sql("SELECT DISTINCT name, CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{k}'" for k, p in fx.GUARD_KINDS) + " ELSE 'unknown' END AS kind FROM (SELECT lower(name) AS name FROM nodes)", "nodes"),
)


def _types(t):
    signature = F.col("signature")
    declared = t("cas_node").select(F.explode(F.concat(F.coalesce(signature["parameters"]["type"], F.array()), F.array(signature["return_type"]))).alias("declared"))
    shape = fx.type_shape(F.col("declared"))
    return declared.where("declared is not null").distinct().select("declared", shape["name"].alias("name"), shape["collection"].alias("collection"))


add("type_shapes", _types)


def _remotes(t):
    host = F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", ""))
    s = t("supplier")
    spelt = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("git@"), host, F.lit(".example:Team/Repo.git"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("https://user@"), host, F.lit(".example/team/repo/"))).otherwise(F.concat(F.lit("ssh://git@"), host, F.lit(".example/team/repo.git")))
    return s.select("s_suppkey", fx.git_remote(spelt).alias("remote"))


add("git_remotes", _remotes, "SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || '.example/team/repo' AS remote FROM supplier")


def _frames(t):
    frames = t("observation").select("id", F.posexplode("event.error.frames").alias("pos", "f"))
    line = F.concat(F.lit("    at "), F.coalesce(F.concat(F.col("f.function"), F.lit(" ")), F.lit("")), F.lit("("), F.col("f.file"), F.lit(":"), F.col("f.line").cast("string"), F.lit(":7)"))
    return frames.select("id", "pos", fx.frame_of_line(line).alias("r")).where("r is not null").select("id", "pos", "r.file", "r.line", "r.function")


add(
    "frame_lines",
    _frames,
    "SELECT id, CAST(i - 1 AS INTEGER) AS pos, f.file AS file, f.line AS line, f.function AS function FROM (SELECT id, unnest(event.error.frames) AS f, generate_subscripts(event.error.frames, 1) AS i FROM observation) WHERE f.file IS NOT NULL AND f.line IS NOT NULL",
)


def _same_sources(t):
    """Files as a build machine names them, below its own root, and files of nodes that likely are one source, met on their last segment."""
    seen = v.nodes(t, "file").where("file is not null").select(F.concat(F.lit("/home/runner/work/"), fx.clean_path(F.col("file"))).alias("frame_file")).distinct()
    held = v.nodes(t, "file").where("file is not null").distinct()
    pairs = seen.withColumn("base", fx.base_name(F.col("frame_file"))).join(held.withColumn("base", fx.base_name(F.col("file"))), "base")
    return pairs.where(fx.same_source(F.col("frame_file"), F.col("file"))).select("frame_file", "file")


_CLEAN = r"regexp_replace(replace({0}, '\', '/'), '^(\./)+', '')"
add(
    "same_sources",
    _same_sources,
    sql(
        f"""WITH a AS (SELECT DISTINCT '/home/runner/work/' || {_CLEAN.format("file")} AS frame_file, '/home/runner/work/' || {_CLEAN.format("file")} AS x FROM nodes WHERE file IS NOT NULL),
        b AS (SELECT DISTINCT file, {_CLEAN.format("file")} AS y FROM nodes WHERE file IS NOT NULL),
        p AS (SELECT frame_file, file, x, y, list_reverse(list_filter(string_split(x, '/'), lambda s: s <> '')) AS l, list_reverse(list_filter(string_split(y, '/'), lambda s: s <> '')) AS r FROM a JOIN b ON string_split(x, '/')[-1] = string_split(y, '/')[-1]),
        c AS (SELECT *, len(list_filter(range(1, least(len(l), len(r)) + 1), lambda n: l[1:n] = r[1:n])) AS tail FROM p)
        SELECT frame_file, file FROM c WHERE x = y OR ends_with(x, '/' || y) OR ends_with(y, '/' || x) OR (tail >= 3 AND tail >= ceil(least(len(l), len(r)) / 2.0))""",
        "nodes",
    ),
)


def _volumes(t):
    event = F.col("event")
    own = F.when(event["status"] >= 500, F.lit(0.0)).otherwise(event["duration_ms"] / 1000)
    bag = F.create_map(F.lit("count"), event["attributes"]["shard"])
    return t("observation").select("id", fx.volume(F.when(~F.isnan(own), own), bag).alias("volume"))


add(
    "event_volumes",
    _volumes,
    """WITH e AS (SELECT id, CASE WHEN event.status >= 500 THEN 0.0 WHEN NOT isnan(event.duration_ms) THEN event.duration_ms / 1000 END AS own, coalesce(TRY_CAST(event.attributes['shard'] AS DOUBLE), 0) AS n FROM observation)
    SELECT id, CAST(CASE WHEN own > 0 THEN floor(own + 0.5) WHEN n > 0 THEN floor(n + 0.5) ELSE 1 END AS BIGINT) AS volume FROM e""",
)


def _fix_risk(t):
    from stratagraph.operators import history, select

    churn = history.file_churn(v.commits(t), v.commit_files(t)).select("path", "fixes", "commits")
    ranked = select.percentile_below(churn, "fixes", "percentile")
    return ranked.select("path", fx.risk_of_fixes(F.col("fixes"), F.col("percentile"), F.col("fixes") / F.col("commits")).alias("risk"))


add(
    "risk_of_fixes",
    _fix_risk,
    sql(
        """WITH c AS (SELECT path, count(*) FILTER (WHERE intent = '1-URGENT') AS fixes FROM commit_files JOIN commits USING (commit_id) GROUP BY path),
        p AS (SELECT path, fixes, floor(100 * (rank() OVER (ORDER BY fixes) - 1) / count(*) OVER ()) AS percentile FROM c)
        SELECT path, CASE WHEN percentile >= 90 AND fixes >= 3 THEN 'high' WHEN percentile >= 75 AND fixes >= 2 THEN 'medium' END AS risk FROM p""",
        "commits",
        "commit_files",
    ),
)
add(
    "interface_signatures",
    lambda t: t("cas_node").where("metadata.is_exported and signature is not null").select("analysis_id", "id", fx.signature_text(F.col("name"), F.col("signature.parameters"), F.col("signature.return_type")).alias("signature")).distinct(),
    """SELECT DISTINCT analysis_id, id, name || '(' || coalesce(array_to_string(list_transform(signature.parameters, lambda p: coalesce(p.name, '_') || CASE WHEN p.optional THEN '?' ELSE '' END || ': ' || coalesce(p.type, 'any')), ', '), '') || ') -> ' || coalesce(signature.return_type, 'void') AS signature
    FROM cas_node WHERE metadata.is_exported AND signature IS NOT NULL""",
)

#: Names that languages bring along.
BUILTIN_NAMES = "print len range map filter push pop slice splice concat join split trim replace append extend insert remove sort reverse format parse stringify log error warn info keys values entries forEach reduce find some every includes indexOf then catch finally toString valueOf hasOwnProperty".split()
add(
    "builtin_names",
    lambda t: v.nodes(t, "id", "name").select("id", F.col("name").isin(BUILTIN_NAMES).alias("builtin")),
    sql("SELECT id, name IN (" + ", ".join(f"'{n}'" for n in BUILTIN_NAMES) + ") AS builtin FROM nodes", "nodes"),
)


_KIND_RULES = {"frontend": "type = 'component' or category = 'presentation'", "backend": "category = 'transport' or category = 'domain'", "data": "category = 'storage'", "scripts": "lower(file) like '%.py'"}

def _codebase(t):
    """Each project's kinds of code with the share of its units that speak for them, at least a tenth."""
    kinds = F.array(*(F.when(F.expr(rule), F.lit(kind)) for kind, rule in _KIND_RULES.items()))
    n = v.nodes(t, "project_id", "type", "category", "file").select("project_id", kinds.alias("kinds"))
    total = n.groupBy("project_id").agg(F.count("*").alias("n"))
    found = n.select("project_id", F.explode("kinds").alias("kind")).where("kind is not null").groupBy("project_id", "kind").agg(F.count("*").alias("k"))
    return found.join(total, "project_id").withColumn("confidence", F.round(F.col("k") / F.col("n"), 3)).where("confidence >= 0.1").select("project_id", "kind", "confidence")


add(
    "codebase_types",
    _codebase,
    sql("WITH k AS (" + " UNION ALL ".join(f"SELECT project_id, '{k}' AS kind, count(*) FILTER (WHERE {r}) AS k, count(*) AS n FROM nodes GROUP BY 1" for k, r in _KIND_RULES.items()) + ") SELECT project_id, kind, round(k / n::DOUBLE, 3) AS confidence FROM k WHERE round(k / n::DOUBLE, 3) >= 0.1", "nodes"),
)
