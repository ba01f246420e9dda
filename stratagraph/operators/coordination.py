"""Agents at work beside each other: what they change, where they meet, and what must be decided.

Work in progress is a table (workspace_id, agent_id, seq, path, patch). None of the operators pairs all
agents of a group: of a group only its size, its least and its greatest member are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.functions import text as fx

#: How a line of a patch declares a unit.
DECLARES = r"\b(?:def|function|func|fn|class|interface|struct|trait)\s+([A-Za-z_]\w*)"
#: Paths of files that are never shown to others, as they hold secrets or are ignored, with the reason.
SECRET_PATHS = (("environment", r"(^|/)\.env(\.[\w-]+)?$"), ("key", r"\.(pem|key|p12|pfx|jks|keystore)$"), ("credentials", r"(^|/)(credentials?|secrets?)(\.[\w-]+)?$"), ("ssh", r"(^|/)(id_rsa|id_ed25519|id_dsa)(\.pub)?$"), ("netrc", r"(^|/)\.(netrc|npmrc|pypirc)$"), ("ignored", r"(^|/)(\.venv|node_modules|site-packages)/"))


def symbol_changes(work: DataFrame) -> DataFrame:
    """Units that patches add, remove or change: workspace_id, agent_id, path, symbol, change.

    A unit declared on added and on removed lines of an agent's patches to a path is changed. Rows without
    agent, path or patch have none; file names of the patch's head are no declarations.
    """
    lines = work.where("agent_id is not null and path is not null and patch is not null").select("workspace_id", "agent_id", fx.clean_path(F.col("path")).alias("path"), F.explode(F.split("patch", "\n")).alias("line"))
    told = lines.where("(line like '+%' and line not like '+++%') or (line like '-%' and line not like '---%')").select("workspace_id", "agent_id", "path", F.substring("line", 1, 1).alias("sign"), F.regexp_extract("line", DECLARES, 1).alias("symbol")).where("symbol <> ''")
    signs = told.groupBy("workspace_id", "agent_id", "path", "symbol").agg(F.max((F.col("sign") == "+").cast("int")).alias("added"), F.max((F.col("sign") == "-").cast("int")).alias("removed"))
    change = F.when((F.col("added") == 1) & (F.col("removed") == 1), "changed").when(F.col("added") == 1, "added").otherwise("removed")
    return signs.select("workspace_id", "agent_id", "path", "symbol", change.alias("change"))


def _meetings(holds: DataFrame, by: list[str], kind: str, order: int) -> DataFrame:
    """Agents that hold the same thing: each meets the group's least agent, and that one its greatest."""
    distinct = holds.select("workspace_id", "agent_id", *by[1:]).distinct()
    heads = distinct.groupBy(*by).agg(F.min("agent_id").alias("least"), F.max("agent_id").alias("greatest")).where("least <> greatest")
    partner = F.when(F.col("agent_id") == F.col("least"), F.col("greatest")).otherwise(F.col("least"))
    return distinct.join(heads, by).select("workspace_id", "agent_id", F.struct(F.lit(order).alias("order"), partner.alias("partner"), F.lit(kind).alias("kind"), F.concat_ws(":", *by[1:]).alias("evidence")).alias("m"))


def arbitration(work: DataFrame) -> DataFrame:
    """One verdict per agent of a workspace: verdict, kind, partner and evidence.

    Agents that touch a path of another one are in conflict by path, else those that touch a unit of the same name by
    symbol; the others are granted. Of several meetings the one with the least partner counts.
    """
    agents = work.where("agent_id is not null").select("workspace_id", "agent_id").distinct()
    paths = work.where("agent_id is not null and path is not null").select("workspace_id", "agent_id", fx.clean_path(F.col("path")).alias("path"))
    found = _meetings(paths, ["workspace_id", "path"], "path", 1).unionByName(_meetings(symbol_changes(work), ["workspace_id", "symbol"], "symbol", 2))
    best = found.groupBy("workspace_id", "agent_id").agg(F.min("m").alias("m"))
    return agents.join(best, ["workspace_id", "agent_id"], "left").select("workspace_id", "agent_id", F.when(F.col("m").isNull(), "granted").otherwise("conflict").alias("verdict"), "m.kind", "m.partner", "m.evidence")


def merge_plan(changes: DataFrame) -> DataFrame:
    """What each changed unit of a workspace asks for: workspace_id, symbol, agents, plan.

    One agent's change merges by itself; several that only add are put in order; all else needs a decision.
    """
    sums = changes.groupBy("workspace_id", "symbol").agg(F.count_distinct("agent_id").alias("agents"), F.min((F.col("change") == "added").cast("int")).alias("only_added"))
    plan = F.when(F.col("agents") == 1, "automatic").when(F.col("only_added") == 1, "ordered").otherwise("decision")
    return sums.select("workspace_id", "symbol", "agents", plan.alias("plan"))


def merge_metrics(changes: DataFrame) -> DataFrame:
    """Per workspace: changed symbols, those that need a decision and their rate (over at least 1)."""
    p = merge_plan(changes).groupBy("workspace_id").agg(F.count("*").alias("symbols"), F.count_if(F.col("plan") == "decision").alias("decisions"))
    return p.withColumn("decision_rate", F.round(F.col("decisions") / F.greatest(F.lit(1), F.col("symbols")), 6))


def conceptual_conflicts(changes: DataFrame, calls: DataFrame) -> DataFrame:
    """Units on which agents of a workspace work against each other: workspace_id, symbol, kind, severity, agents.

    duplicate-work: several agents add a unit of that name. contract-divergence: one changes or removes it
    and another adds a call of it; ``calls`` has workspace_id, agent_id and symbol of added calls.
    """
    added = changes.where("change = 'added'").groupBy("workspace_id", "symbol").agg(F.count_distinct("agent_id").alias("agents")).where("agents > 1").select("workspace_id", "symbol", F.lit("duplicate-work").alias("kind"), F.lit("medium").alias("severity"), "agents")
    turned = changes.where("change <> 'added'").groupBy("workspace_id", "symbol").agg(F.min("agent_id").alias("first"), F.max("agent_id").alias("last"))
    users = calls.groupBy("workspace_id", "symbol").agg(F.min("agent_id").alias("a"), F.max("agent_id").alias("z"), F.count_distinct("agent_id").alias("agents"))
    met = turned.join(users, ["workspace_id", "symbol"]).where("first <> last or a <> z or first <> a")
    return added.unionByName(met.select("workspace_id", "symbol", F.lit("contract-divergence").alias("kind"), F.lit("high").alias("severity"), "agents"))


def added_calls(work: DataFrame) -> DataFrame:
    """workspace_id, agent_id and symbol of calls on added lines; declarations are no calls."""
    lines = work.where("agent_id is not null and patch is not null").select("workspace_id", "agent_id", F.explode(F.split("patch", "\n")).alias("line")).where("line like '+%' and line not like '+++%'")
    bare = F.regexp_replace("line", DECLARES, "")
    return lines.select("workspace_id", "agent_id", F.explode(F.regexp_extract_all(bare, F.lit(r"\b([A-Za-z_]\w*)\("), F.lit(1))).alias("symbol")).distinct()


def contract_drift(changes: DataFrame, declared: DataFrame, consumers: DataFrame) -> DataFrame:
    """Declared units (name, project_id) that an agent takes away or changes while others rely on them.

    Columns name, agent_id, reason ('missing' before 'drift') and consumers, the number of units that call it.
    """
    reason = F.when(F.col("change") == "removed", "missing").when(F.col("change") == "changed", "drift")
    hit = changes.select(F.col("symbol").alias("name"), "agent_id", reason.alias("reason")).where("reason is not null")
    relied = consumers.groupBy("name").agg(F.count("*").alias("consumers"))
    return hit.join(declared.select("name").distinct(), "name", "left_semi").join(relied, "name").groupBy("name", "agent_id", "consumers").agg(F.max("reason").alias("reason"))


def shown_files(work: DataFrame) -> DataFrame:
    """Work whose path is no secret's: files that match a pattern are dropped whole."""
    return work.where(drop_reason(F.col("path")).isNull())


def drop_reason(path: Column) -> Column:
    """Why a file is not shown to others; null if it is."""
    clean = F.lower(fx.clean_path(path))
    out = None
    for reason, pattern in SECRET_PATHS:
        fits = F.coalesce(clean.rlike(pattern), F.lit(False))
        out = F.when(fits, reason) if out is None else out.when(fits, reason)
    return out


def drained(work: DataFrame) -> DataFrame:
    """For each agent and path of its work, how many rows of others came after its own last one: workspace_id, agent_id, path, later.

    What comes after an agent's last row of a path is another's, so a row's place from the end of its path tells.
    """
    rows = work.where("path is not null").select("workspace_id", "agent_id", "seq", fx.clean_path(F.col("path")).alias("path"))
    after = F.row_number().over(W.partitionBy("workspace_id", "path").orderBy(F.col("seq").desc())) - 1
    return rows.withColumn("after", after).where("agent_id is not null").groupBy("workspace_id", "agent_id", "path").agg(F.min("after").alias("later"))


def changes_since(log: DataFrame, epoch: str, cursor: int, own_epoch: str) -> DataFrame:
    """Rows of a log (seq, ...) after a cursor, with gap: whether rows were lost before what is kept, or the log is another one.

    With a gap the whole state is to be read again, so all rows are given.
    """
    kept = log.agg(F.min("seq")).scalar()
    gap = F.lit(epoch != own_epoch) | F.coalesce(F.lit(cursor) < kept - 1, F.lit(False))
    return log.withColumn("gap", gap).where(F.col("gap") | (F.col("seq") > cursor))
