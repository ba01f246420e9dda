"""Sources, stores and streams: round trips, and streams against their batch twins."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratagraph.sources import files as src
from stratagraph.streaming import telemetry as tel


def test_tree_and_facts(spark, tmp_path):
    for path, text in {"a/b.py": "import os\n\nclass K:\n    def f(self):\n        return os.getcwd()\n\ndef f():\n    K().f()\n", "a/bad.py": "def (", "node_modules/x.js": "x", "c.json": "{}" * 40_000, ".git/config": "", "d.ts": "let a"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = {r.path: (r.language, r.oversize) for r in src.discover(spark, str(tmp_path)).collect()}
    assert found == {"a/b.py": ("python", False), "a/bad.py": ("python", False), "c.json": ("json", True), "d.ts": ("typescript", False)}
    df = spark.createDataFrame([("a/b.py", (tmp_path / "a/b.py").read_text()), ("a/bad.py", "def ("), ("n", None)], "path string, content string")
    facts = {tuple(r) for r in src.python_facts(df).collect()}
    assert {("a/b.py", "import", "os", "", 1), ("a/b.py", "class", "K", "", 3), ("a/b.py", "function", "K.f", "K", 4), ("a/b.py", "call", "os.getcwd", "K.f", 5), ("a/b.py", "function", "f", "", 7)} <= facts
    assert ("a/bad.py", "error", "SyntaxError", "", 1) in facts
    ids = [r.id for r in src.stable_ids(spark.createDataFrame([("p", "call", "f", "", 9), ("p", "call", "f", "", 3)], "path string, kind string, name string, owner string, line int")).orderBy("line").collect()]
    assert ids == ["p:call:f", "p:call:f#2"]
    stored = df.select("path", F.sha2("content", 256).alias("content_hash"), F.lit("v1").alias("engine")).where("path = 'a/b.py'")
    assert {r.path for r in src.to_read_again(df, stored, "v1").collect()} == {"a/bad.py", "n"} and src.to_read_again(df, stored, "v2").count() == 3


def test_declared_tables_manifests_reports(spark):
    ddl = [("m/1.sql", "CREATE TABLE users (id int primary key, name varchar(20), PRIMARY KEY (id)); create table old (x int);"), ("m/2.sql", "ALTER TABLE users ADD COLUMN age int; DROP TABLE old; alter table users drop column name;"), ("m/3.sql", "-- create table no1 (id int);\n/* ; create table no2 (id int); */ insert into users values (1, 'it''s; create table no3 (id int);'); create table last (x int);")]
    got = {tuple(r) for r in src.declared_tables(spark.createDataFrame(ddl, "path string, content string")).collect()}
    assert got == {("users", "id", "int"), ("users", "age", "int"), ("last", "x", "int")}
    manifest = [("a/package.json", '{"dependencies": {"x": "1"}, "devDependencies": {"y": "2"}}'), ("b/package.json", "{"), ("c.json", "{}")]
    assert {tuple(r) for r in src.dependencies(spark.createDataFrame(manifest, "path string, content string")).collect()} == {("a/package.json", "x", "1", "production"), ("a/package.json", "y", "2", "dev")}
    report = spark.createDataFrame([("SF:a.py\nDA:1,2\nDA:2,0\nend_of_record\nSF:b.py\nDA:1,1\nend_of_record\n",)], "content string")
    assert {tuple(r) for r in src.line_coverage(report).collect()} == {("a.py", 2, 1), ("b.py", 1, 1)}
    log = spark.createDataFrame([("\x01c1\x0286400\x02Ann\x02fix: a\n\na.py\nb.py\n\x01c2\x0290000\x02Bo\x02b\n\nb.py\n",)], "content string")
    assert {(r.commit, r.author, r.path) for r in src.commit_log(log).collect()} == {("c1", "Ann", "a.py"), ("c1", "Ann", "b.py"), ("c2", "Bo", "b.py")}
    ci = spark.createDataFrame([("ci.yml", "on: push\njobs:\n  build:\n    steps: []\n  test-all:\n    needs: build\nother: 1\n")], "path string, content string")
    assert [tuple(r) for r in src.pipelines(ci).collect()] == [("ci.yml", 0, "build"), ("ci.yml", 1, "test-all")]


def test_sections_and_upsert(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id long, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "id long, v string")
    src.write_sections({"nodes": a}, str(tmp_path), "g1")
    src.write_sections({"nodes": src.upsert(a, b, ["id"])}, str(tmp_path), "g2")
    assert {tuple(r) for r in src.read_section(spark, str(tmp_path), "nodes").collect()} == {(1, "y"), (2, "z")}


@pytest.fixture
def events(spark, tmp_path):
    start = datetime(2025, 1, 1)
    rows = [(f"e{i % 80}", start + timedelta(minutes=17 * i), "svc" if i % 3 else None, 500 if i % 7 == 0 else 200) for i in range(100)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "event_id string, recorded_at timestamp, service_name string, status int").repartition(4).write.parquet(path)
    return path, rows


def test_journal_holds_each_event_once(spark, tmp_path, events):
    path, rows = events
    out = str(tmp_path / "journal")
    for _ in range(2):  # the second run finds nothing new
        tel.write_journal(tel.once(tel.read_observations(spark, path)), out, str(tmp_path / "ck")).awaitTermination(120)
    journal = spark.read.parquet(out)
    assert journal.count() == journal.select("event_id").distinct().count() == 80
    assert {r.day for r in journal.select("day").distinct().collect()} <= {r[1].date() for r in rows}
    kept = tel.within_retention(journal, date(2025, 1, 2), days=1)
    assert {r.day for r in kept.collect()} == {date(2025, 1, 2)}
    assert "PartitionFilters: [isnotnull(day" in kept._jdf.queryExecution().toString()


def test_windows_equal_the_batch(spark, tmp_path, events):
    path, _ = events
    stream = tel.window_counts(tel.read_observations(spark, path), ["service_name"])
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = tel.window_counts(spark.read.parquet(path), ["service_name"])
    assert {str(r) for r in spark.table("windows").collect()} == {str(r) for r in batch.collect()}


def test_bursts_and_compaction(spark):
    start = datetime(2025, 1, 1)
    rows = [("p", start), ("p", start + timedelta(seconds=4)), ("p", start + timedelta(seconds=20)), ("q", start)]
    got = tel.bursts(spark.createDataFrame(rows, "project string, at timestamp"), "project", "at").collect()
    assert sorted((r.project, r.changes) for r in got) == [("p", 1), ("p", 2), ("q", 1)]
    days = spark.createDataFrame([(date(2025, 1, 1), i, n) for i, n in enumerate([5, 3, 50, 4])], "day date, at long, bytes long")
    assert {r.at for r in tel.compact(days, "at", "bytes", budget=10).collect()} == {3, 1}
    assert {r.at for r in tel.compact(days, "at", "bytes", most_rows=2, budget=100).collect()} == {3, 2}


def test_claims_keep_the_latest_and_expire(spark, tmp_path):
    start = datetime(2025, 1, 1)
    batches = [[(1, 1, start, "active"), (2, 2, start, "active"), (1, 3, start + timedelta(minutes=30), "active")], [(2, 4, start + timedelta(minutes=40), "released")], [(9, 5, start + timedelta(hours=5), "active")], [(9, 6, start + timedelta(hours=5, minutes=1), "active")]]
    path = str(tmp_path / "claims")
    schema = "claim_id long, seq long, heartbeat timestamp, status string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = tel.latest_claims(spark.readStream.schema(schema).parquet(path))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.claim_id, r.status, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(1, "active", 3), (2, "active", 2), (2, "released", 4), (1, "expired", 3), (9, "active", 6)} <= got
    assert (2, "expired", 4) not in got and (2, "expired", 2) not in got
