"""Queries that go through sources, stores and streams: what was written is read again. Their SQL reads the tables directly."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from stratagraph.plans import views as v
from stratagraph.plans.views import with_views as sql
from stratagraph.queries.registry import Registry
from stratagraph.session import durable, work_folder
from stratagraph.sources import files as src
from stratagraph.sources import stores
from stratagraph.streaming import telemetry as tel

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
add = _r.add


def _folder(t) -> str:
    """A folder of this query's own below the application's shared one."""
    return f"{work_folder(t.spark)}/{uuid.uuid4().hex}"


def _sections(t):
    """Two generations of a section store; the newest published one is read, by the columns asked for."""
    folder = _folder(t)
    nodes = v.nodes(t, "id", "project_id", "type", "category")
    src.write_sections({"nodes": nodes.where("type = 'class'")}, folder, "g1")
    src.write_sections({"nodes": nodes, "shared": t("shared_node")}, folder, "g2")
    return src.read_section(t.spark, folder, "nodes").groupBy("type").agg(F.count("*").alias("n"))


add("stored_sections", _sections, sql("SELECT type, count(*) AS n FROM nodes GROUP BY 1", "nodes"))


def _whole(t):
    folder = _folder(t)
    stores.write_whole({"edges": v.edges(t, "source", "target", "type", "occurrences")}, folder)
    back = stores.read_whole(t.spark, folder, {"edges": "id string, source string, target string, type string, occurrences int"})["edges"]
    return back.groupBy("type").agg(F.count("*").alias("n"), F.count("target").alias("resolved"), F.sum("occurrences").alias("occurrences"))


add("whole_analysis", _whole, sql("SELECT type, count(*) AS n, count(target) AS resolved, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM edges GROUP BY 1", "edges"))


def _records(t):
    """Points read from a record store: the first unit of each library by id."""
    folder = _folder(t)
    stores.write_records(t("shared_node"), folder, "id", 4)
    wanted = [r.id for r in t("shared_node").groupBy("library").agg(F.min("id").alias("id")).limit(1000).collect()]  # at most 1000 keys, the store's bound
    return stores.read_records(t.spark, folder, "id", wanted)


add("record_points", _records, "SELECT * FROM shared_node WHERE id IN (SELECT min(id) FROM shared_node GROUP BY library)")
add(
    "bounded_page",
    lambda t: stores.bounded(v.nodes(t, "id", "name").withColumn("bytes", F.length("id") + F.length("name")), ["id"], "bytes", 2000, 500).select("id", "bytes", "truncated"),
    sql("WITH p AS (SELECT id, len(id) + len(name) AS bytes FROM nodes ORDER BY id LIMIT 501), s AS (SELECT *, sum(bytes) OVER (ORDER BY id) AS upto, row_number() OVER (ORDER BY id) AS n FROM p) SELECT id, bytes, (SELECT bool_or(upto > 2000 OR n > 500) FROM s) AS truncated FROM s WHERE upto <= 2000 AND n <= 500", "nodes"),
)


def _journal(t):
    """The journal of a stream of observations, written by day in exactly-once batches."""
    folder = _folder(t)
    stream = tel.read_observations(t.spark, f"{t.root}/observation.parquet")
    tel.write_journal(stream.select("id", "recorded_at", "source"), f"{folder}/journal", f"{folder}/marks").awaitTermination()
    return t.spark.read.parquet(f"{folder}/journal")


_DAYS = "SELECT CAST(recorded_at AS DATE) AS day, count(*) AS n FROM observation"
add("journal_days", lambda t: _journal(t).groupBy("day").agg(F.count("*").alias("n")), f"{_DAYS} GROUP BY 1")
add("journal_retained", lambda t: tel.within_retention(_journal(t), date(2025, 3, 20), 14).groupBy("day").agg(F.count("*").alias("n")), f"{_DAYS} WHERE CAST(recorded_at AS DATE) > DATE '2025-03-06' GROUP BY 1")


def _compacted(t, rows=50):
    """The newest rows of each day of the journal, at most ``rows`` (the compaction's bound); ids break ties of time."""
    days = t("observation").select(F.to_date("recorded_at").alias("day"), F.concat_ws("/", F.date_format("recorded_at", "yyyyMMddHHmmssSSSSSS"), "id").alias("at"), F.length("id").cast("long").alias("bytes"))
    return tel.compact(days, "at", "bytes", most_rows=rows).groupBy("day").agg(F.count("*").alias("n"), F.max("at").alias("newest"))


add("journal_compacted", _compacted, "SELECT CAST(recorded_at AS DATE) AS day, least(50, count(*)) AS n, max(strftime(recorded_at, '%Y%m%d%H%M%S%f') || '/' || id) AS newest FROM observation GROUP BY 1")


def _pushed(t):
    """Batches of a stream sent once each, also when the stream starts again over the same marks of what was sent."""
    folder = _folder(t)
    for _ in range(2):
        stream = tel.read_observations(t.spark, f"{t.root}/observation.parquet").select("id", "source")
        send = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/sent")
        tel.push(stream, send, f"{folder}/marks-{uuid.uuid4().hex}", f"{folder}/journal").awaitTermination()
    return t.spark.read.parquet(f"{folder}/sent").groupBy("source").agg(F.count("*").alias("n"))


add("pushed_once", _pushed, "SELECT source, count(*) AS n FROM observation GROUP BY 1")


def _hours(t):
    """Events and errors per hour and service of a stream over all observations, as the table that complete output leaves."""
    folder, name = _folder(t), f"hours_{uuid.uuid4().hex}"
    stream = tel.read_observations(t.spark, f"{t.root}/observation.parquet")
    counts = tel.window_counts(stream.select("recorded_at", F.col("event.service_name").alias("service_name"), F.col("event.status").alias("status")), ["service_name"])
    counts.select(F.col("window.start").alias("hour"), "service_name", "events", "errors").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start().awaitTermination()
    return durable(t.spark.table(name))


add("stream_hours", _hours, "SELECT date_trunc('hour', recorded_at) AS hour, event.service_name AS service_name, count(*) AS events, count(*) FILTER (WHERE coalesce(event.status >= 500, false)) AS errors FROM observation GROUP BY 1, 2")


def _python(t):
    return src.python_facts(t("in_flight_diff_file").where("lower(path) like '%.py' and content is not null").select("path", "content").distinct())


add("python_facts", lambda t: _python(t).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")))
add("python_fact_ids", lambda t: src.stable_ids(_python(t)).groupBy("path").agg(F.count("*").alias("facts"), F.count_distinct("id").alias("ids")))


def _again(t):
    """Files of the later half that aren't known by path and content from the earlier one."""
    files = t("in_flight_diff_file").where("content is not null and path is not null").select("diff_id", "path", "content")
    half = files.agg(F.percentile_approx("diff_id", 0.5, 10_000)).scalar()
    stored = files.where(F.col("diff_id") <= half).select("path", F.sha2("content", 256).alias("content_hash"), F.lit("v1").alias("engine"))
    return src.to_read_again(files, stored, "v1").select("diff_id")


add("files_to_read_again", _again)
add(
    "upserted_vectors",
    lambda t: src.upsert(t("node_embeddings").where("model is not null").select("id", "model").where("id % 3 <> 0"), t("node_embeddings").select("id", F.upper("model").alias("model")).where("id % 2 = 0"), ["id"]).groupBy("model").agg(F.count("*").alias("n")),
    "WITH s AS (SELECT id, model FROM node_embeddings WHERE model IS NOT NULL AND id % 3 <> 0), n AS (SELECT id, upper(model) AS model FROM node_embeddings WHERE id % 2 = 0) SELECT model, count(*) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM s WHERE id NOT IN (SELECT id FROM n)) GROUP BY 1",
)


def _ddl(t):
    """A migration per brand of parts, as text: a table, a changed one for odd brands, a dropped one for brands of 5."""
    name = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"))
    odd, fifth = F.col("p_brand").rlike("[13579]$"), F.col("p_brand").rlike("5$")
    text = F.concat(F.lit("CREATE TABLE "), name, F.lit(" (id int, name varchar(20), PRIMARY KEY (id)); "), F.when(odd, F.concat(F.lit("ALTER TABLE "), name, F.lit(" ADD COLUMN size int; "))).otherwise(""), F.when(fifth, F.concat(F.lit("DROP TABLE "), name, F.lit(";"))).otherwise(""))
    return src.declared_tables(t("part").select("p_brand").distinct().select(name.alias("path"), text.alias("content")))


add(
    "declared_tables",
    _ddl,
    """WITH b AS (SELECT DISTINCT p_brand, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) AS t FROM part) SELECT t AS "table", c AS "column", CASE c WHEN 'name' THEN 'varchar(20)' ELSE 'int' END AS type
    FROM b, (SELECT unnest(['id', 'name', 'size']) AS c) WHERE NOT regexp_matches(p_brand, '5$') AND (c <> 'size' OR regexp_matches(p_brand, '[13579]$'))""",
)


def _manifests(t):
    text = F.concat(F.lit('{"dependencies": {"lib'), F.col("s_nationkey").cast("string"), F.lit('": "1.'), (F.col("s_suppkey") % 7).cast("string"), F.lit('"}, "devDependencies": {"check": "2"}}'))
    files = t("supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string"), F.lit("/package.json")).alias("path"), text.alias("content"))
    return src.dependencies(files).groupBy("package", "scope").agg(F.count("*").alias("n"), F.max("version").alias("version"))


add("manifest_dependencies", _manifests, "SELECT package, scope, count(*) AS n, max(version) AS version FROM (SELECT 'lib' || s_nationkey AS package, 'production' AS scope, '1.' || (s_suppkey % 7) AS version FROM supplier UNION ALL SELECT 'check', 'dev', '2' FROM supplier) GROUP BY 1, 2")


def _coverage(t):
    """A coverage report of all files as text, read back: each unit's first line, hit as often as the unit is complex."""
    hits = v.nodes(t, "id", "file", "line", "cyclomatic").where("file is not null and line is not null").select("file", F.concat(F.lit("DA:"), F.col("line").cast("string"), F.lit(","), F.coalesce("cyclomatic", F.lit(0)).cast("string")).alias("hit"))
    reports = hits.groupBy("file").agg(F.concat_ws("\n", F.concat(F.lit("SF:"), F.col("file")), F.concat_ws("\n", F.collect_list("hit")), F.lit("end_of_record")).alias("content"))
    return src.line_coverage(reports)


add("coverage_of_files", _coverage, sql("SELECT file, count(*) AS lines, count(*) FILTER (WHERE coalesce(cyclomatic, 0) <> 0) AS covered FROM nodes WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY 1", "nodes"))


def _log(t):
    """The commits as a log's text, one per author, read back and counted by author and day."""
    files = v.commit_files(t).groupBy("commit_id").agg(F.concat_ws("\n", F.collect_list("path")).alias("paths"))
    entry = F.concat(F.lit("\x01"), F.col("commit_id").cast("string"), F.lit("\x02"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"), F.lit("\x02a"), F.col("author").cast("string"), F.lit("\x02"), "intent", F.lit("\n\n"), "paths", F.lit("\n"))
    logs = v.commits(t).join(files, "commit_id").groupBy("author").agg(F.concat_ws("", F.collect_list(entry)).alias("content"))
    return src.commit_log(logs).groupBy("author").agg(F.count("*").alias("changes"), F.count_distinct("commit").alias("commits"), F.max("ts").alias("last_at"))


add("commit_log_authors", _log, sql("SELECT 'a' || author AS author, count(*) AS changes, count(DISTINCT commit_id) AS commits, max(ts) AS last_at FROM commits JOIN commit_files USING (commit_id) GROUP BY 1", "commits", "commit_files"))


def _jobs(t):
    """A pipeline file per region with a job per nation, read back."""
    name = F.lower(F.regexp_replace("n_name", "[^A-Za-z0-9]", "-"))
    jobs = t("nation").select("n_regionkey", F.struct("n_nationkey", F.concat(F.lit("  j-"), name, F.lit(":\n    steps: []")).alias("text")).alias("j")).groupBy("n_regionkey").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("j")), lambda j: j["text"])).alias("jobs"))
    files = jobs.select(F.concat(F.lit("ci/"), F.col("n_regionkey").cast("string"), F.lit(".yml")).alias("path"), F.concat(F.lit("on: push\njobs:\n"), "jobs", F.lit("\nend: 1\n")).alias("content"))
    return src.pipelines(files)


add("pipeline_jobs", _jobs, "SELECT 'ci/' || n_regionkey || '.yml' AS path, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS position, 'j-' || lower(regexp_replace(n_name, '[^A-Za-z0-9]', '-', 'g')) AS job FROM nation")
