"""Analyzer packs: rules given as data, which find facts in files of one language where their conditions hold."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions.text import clean_path, language_of

#: Kinds of facts a rule may emit.
KINDS = ("entry_point", "entity", "edge", "binding", "role")
RULE = "pack string, language string, rule string, pattern string, kind string, name string, detail string, if_file string, if_import string"


def rules_of(spark: SparkSession, packs: list[dict]) -> DataFrame:
    """The rules of packs as a table, one row per rule and fact it emits; ValueError if a pack is not well-formed.

    A pack is {"name", "language", "applies_when": {"file", "import"}, "rules": [{"name", "pattern", "emit":
    [{"kind", "name", "detail"}]}]}. ``pattern`` is a regular expression; '$1' to '$9' in name and detail stand for its groups.
    """
    rows = []
    for pack in packs:
        missing = {"name", "language", "rules"} - set(pack)
        if missing:
            raise ValueError(f"pack without {sorted(missing)}")
        when = pack.get("applies_when") or {}
        for rule in pack["rules"]:
            re.compile(rule["pattern"])
            for emit in rule["emit"]:
                if emit.get("kind") not in KINDS:
                    raise ValueError(f"unknown kind {emit.get('kind')!r} in {pack['name']}")
                rows.append((pack["name"], pack["language"], rule["name"], rule["pattern"], emit["kind"], emit["name"], emit.get("detail"), when.get("file"), when.get("import")))
    return spark.createDataFrame(rows, RULE)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Rules of the JSON files of packs below a path."""
    return rules_of(spark, [json.loads(r.value) for r in spark.read.text(path, wholetext=True).collect()])  # as many as packs are installed


def applying(rules: DataFrame, files: DataFrame) -> DataFrame:
    """The rules whose pack's condition some file (path, content) meets: a file of that name, or one with that text."""
    wanted = rules.select("pack", "if_file", "if_import").distinct()
    held = F.coalesce(F.expr("endswith(path, if_file)"), F.lit(False)) | F.coalesce(F.expr("contains(content, if_import)"), F.lit(False))
    # Files meet the few conditions where they lie; only which pack was met leaves a task.
    met = files.select("path", "content").join(F.broadcast(wanted.where("if_file is not null or if_import is not null")), held).select("pack").distinct()
    free = wanted.where("if_file is null and if_import is null")
    return rules.join(met.unionByName(free.select("pack")).distinct(), "pack", "left_semi")


def facts(files: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Facts that rules find in files (``key``, path, content): pack, rule, kind, name, detail and times.

    Rules are as many as packs give and are sent to every task; each looks only at files of its language.
    A rule's matches are all its non-overlapping ones; equal facts of a file are one with their number.
    """
    sources = files.where("content is not null and path is not null").select(key, language_of(clean_path(F.col("path"))).alias("language"), "content")
    met = sources.join(F.broadcast(rules), "language")
    whole = met.select(key, "pack", "rule", "kind", "name", "detail", "pattern", F.explode(F.expr("regexp_extract_all(content, pattern, 0)")).alias("match"))

    def filled(template):
        out = F.col(template)
        for i in range(1, 4):
            value = F.expr(f"case when contains({template}, '${i}') then regexp_extract(match, pattern, {i}) else '' end")
            out = F.replace(out, F.lit(f"${i}"), value)
        return out

    return whole.select(key, "pack", "rule", "kind", filled("name").alias("name"), filled("detail").alias("detail")).groupBy(key, "pack", "rule", "kind", "name", "detail").agg(F.count("*").alias("times"))
