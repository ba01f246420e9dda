"""Views that the queries of the reference operators read: graph, telemetry, history and claims.

Each view is a function of the catalog and has a twin in SQL (``SQL_VIEWS``), so that a query and its
SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.catalog import Catalog

NODE_COLUMNS = "project_id id name type qualified_name category level description ordinal file line end_line is_test is_exported is_generated cyclomatic throws parameters parent tags".split()


def nodes(t: Catalog, *columns: str) -> DataFrame:
    """The latest row of each node of a project over all its snapshots: ``columns``, or all of NODE_COLUMNS."""
    wanted = columns or tuple(NODE_COLUMNS)
    meta, source = F.col("metadata"), F.col("source")
    flat = t("cas_node").select(
        "project_id", "snapshot_no", "recorded_at", "id", "name", "type", "qualified_name", "category", "level", "description", "ordinal",
        source["file"].alias("file"), source["line"].alias("line"), source["end_line"].alias("end_line"),
        meta["is_test"].alias("is_test"), meta["is_exported"].alias("is_exported"), meta["is_generated"].alias("is_generated"), meta["cyclomatic"].alias("cyclomatic"),
        F.col("signature.throws").alias("throws"), F.size("signature.parameters").alias("parameters"), "parent", "tags",
    )
    last = flat.groupBy("project_id", "id").agg(F.max_by(F.struct(*wanted), F.struct("snapshot_no", "recorded_at")).alias("r"))
    return last.select("r.*")


EDGE_COLUMNS = "project_id source target type category ordinal via weight confidence occurrences".split()


def edge_rows(t: Catalog) -> DataFrame:
    """Edges as delivered, repeated rows and all: for joins and sums that repetition does not change."""
    return t("cas_edge").select("id", *EDGE_COLUMNS)


def edges(t: Catalog, *columns: str) -> DataFrame:
    """Edges without repeated rows: id and ``columns``, or all. Only what is named is read and shuffled."""
    return t("cas_edge").select("id", *(columns or EDGE_COLUMNS)).distinct()


def calls(t: Catalog) -> DataFrame:
    """Distinct (source, target) of calls and invocations between two nodes, without self loops."""
    return edge_rows(t).where("type in ('calls', 'invokes') and target is not null and source <> target").select("source", "target").distinct()


def observations(t: Catalog) -> DataFrame:
    """Runtime events with their place in the delivery: flat columns of the event struct."""
    e = F.col("event")
    names = ["event_id", "kind", "service_name", "environment", "trace_id", "method", "route", "path", "status", "duration_ms"]
    return t("observation").select("id", "project_path", "recorded_at", F.col("source").alias("feed"), *(e[n].alias(n) for n in names), e["error"]["type"].alias("error_type"), e["error"]["message"].alias("error_message"), F.col("correlation")["status"].alias("match_status"), F.col("correlation")["best_match"]["id"].alias("match_id"), F.col("correlation")["best_match"]["confidence"].alias("match_confidence"))


def commits(t: Catalog) -> DataFrame:
    """Orders as commits: commit_id, ts, author, intent, risk."""
    risk = F.when(F.col("o_orderstatus") == "F", "low").when(F.col("o_orderstatus") == "O", "medium").otherwise("high")
    return t("orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("intent"), risk.alias("risk"))


def commit_files(t: Catalog) -> DataFrame:
    """Line items as file changes, one row per commit and file: commit_id, path, added, removed."""
    joined = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    path = F.concat(F.lit("b/"), "p_brand", F.lit("/"), F.col("l_partkey").cast("string"))
    return joined.groupBy(F.col("l_orderkey").alias("commit_id"), path.alias("path")).agg(F.sum(F.floor("l_quantity")).cast("long").alias("added"), F.sum(F.floor(F.col("l_discount") * 100 + 0.0001)).cast("long").alias("removed"))


def claims(t: Catalog) -> DataFrame:
    """Events as a log of work claims: claim_id, seq, heartbeat, status, ttl_ms and a path prefix."""
    status = F.when(F.col("event_type") == "signup", "released").otherwise("active")
    return t("events").select(F.col("user_id").alias("claim_id"), F.col("event_id").alias("seq"), F.col("ts").alias("heartbeat"), status.alias("status"), F.lit(3_600_000).cast("long").alias("ttl_ms"), F.concat_ws("/", F.lit("src"), F.col("event_type"), (F.col("user_id") % 10).cast("string")).alias("path"))


#: The same views in SQL, as named subqueries.
SQL_VIEWS = {
    "nodes": """SELECT project_id, id, name, type, qualified_name, category, level, description, ordinal, source.file AS file, source.line AS line, source.end_line AS end_line,
        metadata.is_test AS is_test, metadata.is_exported AS is_exported, metadata.is_generated AS is_generated, metadata.cyclomatic AS cyclomatic, signature.throws AS throws,
        len(signature.parameters) AS parameters, parent, tags
      FROM cas_node QUALIFY row_number() OVER (PARTITION BY project_id, id ORDER BY snapshot_no DESC, recorded_at DESC) = 1""",
    "edges": "SELECT DISTINCT id, project_id, source, target, type, category, ordinal, via, weight, confidence, occurrences FROM cas_edge",
    "calls": "SELECT DISTINCT source, target FROM cas_edge WHERE type IN ('calls', 'invokes') AND target IS NOT NULL AND source <> target",
    "obs": """SELECT id, project_path, recorded_at, source AS feed, event.event_id AS event_id, event.kind AS kind, event.service_name AS service_name, event.environment AS environment,
        event.trace_id AS trace_id, event.method AS method, event.route AS route, event.path AS path, event.status AS status, event.duration_ms AS duration_ms, event.error.type AS error_type,
        event.error.message AS error_message, correlation.status AS match_status, correlation.best_match.id AS match_id, correlation.best_match.confidence AS match_confidence FROM observation""",
    "commits": "SELECT o_orderkey AS commit_id, o_orderdate AS ts, o_custkey AS author, o_orderpriority AS intent, CASE o_orderstatus WHEN 'F' THEN 'low' WHEN 'O' THEN 'medium' ELSE 'high' END AS risk FROM orders",
    "commit_files": """SELECT l_orderkey AS commit_id, 'b/' || p_brand || '/' || l_partkey AS path, CAST(sum(floor(l_quantity)) AS BIGINT) AS added, CAST(sum(floor(l_discount * 100 + 0.0001)) AS BIGINT) AS removed
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""",
    "claims": """SELECT user_id AS claim_id, event_id AS seq, ts AS heartbeat, CASE event_type WHEN 'signup' THEN 'released' ELSE 'active' END AS status, 3600000 AS ttl_ms,
        'src/' || event_type || '/' || (user_id % 10) AS path FROM events""",
}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """SQL with the views it reads as named subqueries before its own."""
    head = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    body = sql.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
