"""Source trees, manifests, reports and logs as tables, and stores for analyses and vectors."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions.text import language_of

#: Folders that are never read, and the sizes in bytes up to which files are.
IGNORED = "node_modules|dist|build|target|vendor|coverage|__pycache__"
LARGEST_CODE, LARGEST_TEXT = 8 << 20, 64 << 10
TEXT_LANGUAGES = ("json", "yaml", "toml", "markdown", "html", "css")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root: path (relative), length, language, oversize. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(root.rstrip('/'))}/", "")
    table = files.select(relative.alias("path"), "length").withColumn("language", language_of(F.col("path")))
    limit = F.when(F.col("language").isin(*TEXT_LANGUAGES), LARGEST_TEXT).otherwise(LARGEST_CODE)
    return table.where(~F.col("path").rlike(rf"(^|/)(\.[^/]+|{IGNORED})/")).withColumn("oversize", F.col("length") > limit)


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of Python sources (path, content): path, kind (function, class, call, import), name, owner, line.

    Names carry their classes and functions with dots. A file that doesn't parse gives one fact of kind
    'error'; null contents give none. One file is parsed at a time.
    """
    schema = "path string, kind string, name string, owner string, line int"

    def walk(node: ast.AST, owner: str) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{owner}.{child.name}" if owner else child.name
                yield "class" if isinstance(child, ast.ClassDef) else "function", inner, owner, child.lineno
            elif isinstance(child, ast.Call):
                yield "call", ast.unparse(child.func), owner, child.lineno
            elif isinstance(child, ast.Import):
                yield from (("import", a.name, owner, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                yield from (("import", f"{'.' * child.level}{child.module or ''}.{a.name}", owner, child.lineno) for a in child.names)
            yield from walk(child, inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if content is None:
                    continue
                try:
                    rows += [(path, *fact) for fact in walk(ast.parse(content), "")]
                except (SyntaxError, ValueError, RecursionError) as error:
                    rows.append((path, "error", type(error).__name__, "", getattr(error, "lineno", None) or 0))
            columns = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 4 + (pa.int32(),))], names=["path", "kind", "name", "owner", "line"])

    return files.select("path", "content").mapInArrow(run, schema)


def to_read_again(files: DataFrame, facts: DataFrame, engine: str) -> DataFrame:
    """Files (path, content) whose facts of this engine and content aren't stored yet (path, content_hash, engine)."""
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    return hashed.join(facts.where(F.col("engine") == engine).select("path", "content_hash").distinct(), ["path", "content_hash"], "left_anti")


def stable_ids(facts: DataFrame) -> DataFrame:
    """Adds id: path, kind and name, with '#n' for the n-th repetition in line order, so ids survive edits elsewhere."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("path", "kind", "name").orderBy("line"))
    base = F.concat_ws(":", "path", "kind", "name")
    return facts.withColumn("id", F.when(n == 1, base).otherwise(F.concat(base, F.lit("#"), n.cast("string"))))


def declared_tables(files: DataFrame) -> DataFrame:
    """Tables and columns of CREATE TABLE statements and the state after ALTER and DROP, in (path, position) order.

    (table, column) with its type as left standing; statements of one table are folded by their last one.
    """
    # Comments and the insides of string literals hold no statements and no ends of statements.
    plain = F.regexp_replace(F.regexp_replace("content", r"'(?:[^']|'')*'", "''"), r"--[^\n]*|(?s:/\*.*?\*/)", " ")
    statements = files.select("path", F.posexplode(F.split(plain, ";")).alias("pos", "s"))
    made = statements.select("path", "pos", F.lower(F.regexp_extract("s", r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)", 1)).alias("table"), F.regexp_extract("s", r"(?is)\((.*)\)", 1).alias("body")).where("`table` <> ''")
    columns = made.select("path", "pos", "table", F.explode(F.split("body", r",(?![^(]*\))")).alias("c")).select("path", "pos", "table", F.lower(F.regexp_extract("c", r"^\s*[\"`]?(\w+)", 1)).alias("column"), F.lower(F.regexp_extract("c", r"^\s*[\"`]?\w+[\"`]?\s+(\w+(?:\([^)]*\))?)", 1)).alias("type"))
    columns = columns.where(~F.col("column").isin("primary", "foreign", "unique", "constraint", "check", "") & (F.col("type") != ""))
    added = statements.select("path", "pos", F.lower(F.regexp_extract("s", r"(?is)alter\s+table\s+[\"`]?([\w.]+)", 1)).alias("table"), F.lower(F.regexp_extract("s", r"(?is)add\s+(?:column\s+)?[\"`]?(\w+)", 1)).alias("column"), F.lower(F.regexp_extract("s", r"(?is)add\s+(?:column\s+)?[\"`]?\w+[\"`]?\s+(\w+(?:\([^)]*\))?)", 1)).alias("type")).where("`table` <> '' and type <> ''")
    gone = statements.select("path", "pos", F.lower(F.regexp_extract("s", r"(?is)alter\s+table\s+[\"`]?([\w.]+)", 1)).alias("table"), F.lower(F.regexp_extract("s", r"(?is)drop\s+column\s+[\"`]?(\w+)", 1)).alias("column"), F.lit(None).cast("string").alias("type")).where("`table` <> '' and column <> ''")
    last = columns.unionByName(added).unionByName(gone).groupBy("table", "column").agg(F.max_by(F.struct("type", "path", "pos"), F.struct("path", "pos")).alias("r"))
    dropped = statements.select(F.lower(F.regexp_extract("s", r"(?is)drop\s+table\s+(?:if\s+exists\s+)?[\"`]?([\w.]+)", 1)).alias("table"), F.struct("path", "pos").alias("at")).where("`table` <> ''").groupBy("table").agg(F.max("at").alias("dropped"))
    standing = last.join(dropped, "table", "left").where(F.col("dropped").isNull() | (F.struct("r.path", "r.pos") > F.col("dropped")))
    return standing.select("table", "column", F.col("r.type").alias("type")).where("type is not null")


def dependencies(files: DataFrame) -> DataFrame:
    """Declared packages of package.json files: path, package, version, scope; broken files give none."""
    parsed = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select("path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>").alias("j"))
    scopes = {"production": "dependencies", "dev": "devDependencies", "peer": "peerDependencies"}
    parts = [parsed.select("path", F.explode(F.col("j")[column]).alias("package", "version"), F.lit(scope).alias("scope")) for scope, column in scopes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def line_coverage(reports: DataFrame) -> DataFrame:
    """Covered and all lines per source file of LCOV reports (content): file, lines, covered."""
    rows = reports.select(F.explode(F.split("content", "end_of_record")).alias("r"))
    files = rows.select(F.regexp_extract("r", r"SF:([^\n]+)", 1).alias("file"), F.regexp_extract_all("r", F.lit(r"DA:\d+,(\d+)"), F.lit(1)).alias("hits")).where("file <> ''")
    return files.groupBy("file").agg(F.sum(F.size("hits")).alias("lines"), F.sum(F.size(F.filter("hits", lambda h: h != "0"))).alias("covered"))


def commit_log(logs: DataFrame) -> DataFrame:
    """Commits of ``git log --name-only --format='%x01%H%x02%ct%x02%an%x02%s'`` texts (content): commit, ts, author, subject, path."""
    entries = logs.select(F.explode(F.filter(F.split("content", "\x01"), lambda e: e != "")).alias("e"))
    head = F.split(F.substring_index("e", "\n", 1), "\x02")
    paths = F.filter(F.slice(F.split("e", "\n"), F.lit(2), F.size(F.split("e", "\n"))), lambda p: p != "")
    return entries.select(head[0].alias("commit"), F.timestamp_seconds(head[1].cast("long")).alias("ts"), head[2].alias("author"), head[3].alias("subject"), F.explode(paths).alias("path"))


def pipelines(files: DataFrame) -> DataFrame:
    """Jobs of CI files in YAML with a top-level 'jobs' key: path, job, position, from indentation alone."""
    lines = files.where(F.col("path").rlike(r"\.ya?ml$")).select("path", F.regexp_extract("content", r"(?s)(?:^|\n)jobs:\s*\n(.*?)(?:\n\S|$)", 1).alias("body"))
    return lines.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?m)^  (\w[\w-]*):"), F.lit(1))).alias("position", "job"))


def write_sections(tables: dict[str, DataFrame], root: str, generation: str) -> None:
    """One Parquet folder per table below a generation, and a manifest once all of them are there."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{generation}/{name}")
    spark.createDataFrame([(generation, json.dumps(sorted(tables)))], "generation string, tables string").coalesce(1).write.mode("append").json(f"{root}/_manifest")


def read_section(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest published generation; unpublished ones are not seen."""
    newest = spark.read.schema("generation string, tables string").json(f"{root}/_manifest").agg(F.max("generation")).first()[0]
    return spark.read.parquet(f"{root}/{newest}/{name}")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows replaced or extended by new ones with the same keys."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
