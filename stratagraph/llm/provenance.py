"""Files nobody in a project wrote by hand: generated, minified, vendored, or data saved as code."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.llm import transducer
from stratagraph.session import durable, spread

# Places and names that tools and package managers use.
VENDORED_PATH = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|_vendor|third[_-]party|thirdparty|Godeps|Pods|Carthage|\.venv|virtualenv)/|(?:^|/)vendor/[^/]+/.+")
GENERATED_PATH = re.compile(r"(?:^|/)(?:generated|__generated__|generated[-_]sources|auto[-_]?gen(?:erated)?|dist)/|(?:^|/)build/(?:lib|libs|classes|generated|intermediates)/|(?:^|/)target/(?:classes|generated|debug|release)")
GENERATED_NAME = re.compile(r"(?:^|/)zz_generated[^/]*$|(?:^|/)[^/]+(?:\.pb\.(?:go|cc|h|py)|_pb2(?:_grpc)?\.pyi?|\.pb-c\.[ch]|[._]generated\.\w+|\.gen\.\w+|_gen\.go|\.g\.(?:dart|cs)|\.designer\.cs|\.min\.(?:js|css|mjs)|[.-]bundle\.js|\.(?:js|css)\.map|[-.][0-9a-f]{8,}\.(?:js|css|mjs))$")
LOCK_NAME = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Pipfile\.lock|Cargo\.lock|composer\.lock|Gemfile\.lock|go\.sum|mix\.lock|pubspec\.lock|uv\.lock|flake\.lock|packages\.lock\.json)$")
# What tools and copies say of themselves in the comments at the top of a file.
GENERATED_HEADER = re.compile(
    r"@generated\b|<auto-?generated|\bgenerated (?:by|from|with)\b[^\n]*\b(?:do not|don't|v?\d+\.\d+)|\b(?:auto-?generated|automatically (?:generated|produced|created)|machine[- ](?:made|generated))\b[^\n]*(?:file|output|bindings|\bby\b|from\b|edit)|\bcode generated\b|"
    r"\bautomatisch (?:erzeugt|generiert)|\b(?:fichier|fichero|archivo|c[oó]digo) g[eé]n[eé]r[eé]?(?:ado)? |\b(?:genere|généré|generado) (?:par|por|automáticamente)|\bdo not (?:modify|edit) (?:this file|by hand)|\b(?:hand |manual )?(?:edits|changes) (?:will be|are) (?:lost|overwritten)",
    re.I,
)
COPIED_HEADER = re.compile(
    r"\bcopied (?:verbatim |unchanged |as is )?from https?://|\b(?:imported|vendored|taken|copied|pulled|forked) from (?:upstream\b|https?://)|\bsynced with [\w./-]+@v?\d|\borigin: [\w./-]+ v?\d+\.\d|\bthis file is part of [\w./-]+ v?\d+\.\d|"
    r"\b[\w.-]+ (?:[\w.]+ library )?v\d+\.\d+(?:\.\d+)?\b[^\n]*(?:licen[cs]e|\(c\)|copyright|contributors)|\b[\w.-]+ \d+\.\d+(?:\.\d+)?\s+(?:--|-|—|\|)\s*(?:\(c\)|copyright)|\bto use this [\w.-]+ copy\b|spdx-filecopyrighttext: [^\n]*\bdevelopers\b",
    re.I,
)
NOT_GENERATED = re.compile(r"\bnot (?:auto-?)?generated\b|\bwritten by hand\b|\bhand-?written\b", re.I)
_LINE = re.compile(r"[^\r\n]+")
_BLOCK = re.compile(r"\s*(/\*|<!--)")
_CLOSES = {"/*": "*/", "<!--": "-->"}
_COMMENT = re.compile(r"^\s*(?://+!?|#+|--+|/\*+!?|\*+/?|<!--|;+|%+|\"\"\"|''')")


def clean_path(path: str | None) -> str:
    """One spelling of a path: slashes forward, without a leading './'."""
    return re.sub(r"^(?:\./)+|(?<=/)\./", "", re.sub(r"[\\/]+", "/", path or ""))


def by_path(path: str | None) -> str | None:
    """'vendored', 'generated' or 'lock' if a path says so. A folder named vendor must hold folders of its own."""
    path = clean_path(path)
    if VENDORED_PATH.search(path):
        return "vendored"
    if LOCK_NAME.search(path):
        return "lock"
    return "generated" if GENERATED_PATH.search(path) or GENERATED_NAME.search(path) else None


def head_comments(text: str, code_lines: int = 14) -> str:
    """The comments before the first lines of code, however long they are.

    A file's head ends where more than ``code_lines`` lines that are neither blank nor comment have come.
    Lines between the marks of a block comment belong to it with and without marks of their own.
    """
    out, code, until = [], 0, None
    for m in _LINE.finditer(text):
        line = m[0]
        if until is not None:
            out.append(line)
            until = None if until in line else until
        elif _COMMENT.match(line):
            out.append(line)
            opened = _BLOCK.match(line)
            if opened and (close := _CLOSES[opened[1]]) not in line[opened.end() :]:
                until = close
        elif line.strip():
            code += 1
            if code > code_lines:
                break
    return "\n".join(out)


def by_header(text: str) -> str | None:
    """'generated' or 'vendored' if the comments at the top say so; remarks about other files don't count."""
    head = head_comments(text)
    if not head:
        return None
    if COPIED_HEADER.search(head):
        return "vendored"
    said = "\n".join(x for x in head.split("\n") if not NOT_GENERATED.search(x))
    return "generated" if GENERATED_HEADER.search(said) else None


_LITERAL = re.compile(r"'[^']*'|\"[^\"]*\"|`[^`]*`")
_NUMBER = re.compile(r"0x[0-9a-fA-F]+|-?\d[\d.]*")
_PACKED = re.compile(r"[;{}][A-Za-z_$!(.#]")
_BLOB = re.compile(r"[A-Za-z0-9+/_=-]{200,}")


def _row_of(line: str) -> str:
    """A line without what its literals and numbers say."""
    return _NUMBER.sub("0", _LITERAL.sub("Q", line))


_known_row = lru_cache(maxsize=1 << 17)(_row_of)


def _packed(line: str) -> bool:
    if _COMMENT.match(line):
        return False
    bare = _LITERAL.sub("Q", line)
    return len(bare) > 120 if len(line) > 200 else len(_PACKED.findall(bare)) >= 3


def by_composition(text: str, encode) -> str | None:
    """'minified' or 'data' by what a text is made of: long dense lines, one row pattern all over, or blobs.

    Each rule also wants few characters per subword, which sets code and tables of tools apart from
    prose and from long comment lines.
    """
    lines = [x for x in text.replace("\r", "\n").split("\n") if x.strip()]
    if not lines:
        return None
    size = sum(map(len, lines))
    spaces = sum(x.count(" ") + x.count("\t") for x in lines)
    # A long line that is but one literal is no code; a short one is packed if statements follow each other without a space.
    dense = size - spaces >= 0.93 * size and sum(len(x) for x in lines if _packed(x)) >= 0.5 * size
    rows = Counter(_known_row(x.strip()) if len(x) < 200 else _row_of(x.strip()) for x in lines)
    row, count = rows.most_common(1)[0]
    tabular = len(lines) >= 12 and count >= 0.6 * len(lines) and "0" in row
    blob = sum(len(m) for m in _BLOB.findall(text)) >= 0.75 * size
    if not (dense or tabular or blob):
        return None
    per_subword = len(text) / max(1, len(encode(text)))
    if blob and per_subword < 1.8:
        return "data"
    if tabular and per_subword < 2.6:
        return "data"
    return "minified" if dense and per_subword < 2.7 else None


_VERSION = re.compile(r"[@-]?v?\d+(?:\.\d+)+")
_TAIL = re.compile(r".*(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|_vendor|third[_-]party|thirdparty|Godeps|Pods|Carthage|\.venv|virtualenv|vendor)/(.+)$")


def library_of(path: str | None, text: str) -> str:
    """A name for the third-party file that a file with third-party evidence is a version of.

    It is the path below the folder of third-party files, else the file's name with what its header says
    of its origin; version numbers are left out, so that versions of a file share its name.
    """
    path = clean_path(path)
    if m := _TAIL.match(path):
        name = m[1]
    else:
        said = COPIED_HEADER.search(head_comments(text))
        name = path.rpartition("/")[2] + (f"#{said[0].lower()}" if said else "")
    return _VERSION.sub("", name)


def evidence(files: DataFrame, key: str = "diff_id", folder: str = transducer.FOLDER, name: str = transducer.NAME) -> DataFrame:
    """``key``, path_kind, head_kind, body_kind and library of each file: what path, header and composition say, null for nothing.

    ``library`` names the third-party file where path or header speak of one. Null and empty contents have
    no header and no composition, null paths say nothing; composition is only looked at where path and
    header say nothing.
    """
    names = ["path_kind", "head_kind", "body_kind", "library"]
    schema = f"key {files.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} string" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer.load(folder, name).encode
        for batch in batches:
            kinds = []
            for path, content in zip(batch.column(1), batch.column(2)):
                path, text = path.as_py(), content.as_py() or ""
                p, h = by_path(path), by_header(text) if text else None
                kinds.append((p, h, by_composition(text, encode) if text and not p and not h else None, library_of(path, text) if text and "vendored" in (p, h) else None))
            columns = zip(*kinds) if kinds else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in columns)], names=["key", *names])

    return spread(files.select(F.col(key).alias("key"), "path", "content")).mapInArrow(run, schema).withColumnRenamed("key", key)


def content_lines(contents: DataFrame) -> DataFrame:
    """(text, line, chars): hashes of the distinct lines of distinct contents, without white space at their ends; blank lines aren't counted."""
    split = F.filter(F.transform(F.split("content", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    hashed = F.array_distinct(F.transform(split, lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("chars"))))
    return contents.select("text", F.inline(hashed))


def contained_copies(files: DataFrame, known: DataFrame, key: str = "diff_id", share: float = 0.8, mass: int = 64, hot: int = 1000, salts: int = 16) -> DataFrame:
    """``key``, library and containment of the files whose lines stand, to at least ``share``, in one third-party file.

    ``known`` has the keys of files with third-party evidence and their library; all versions of a library
    file are one document of the inverted index (line hash -> libraries). Beside a library a line counts by
    its rarity, the number of libraries that the library's own rarest tenth of lines stands in by the number
    that the line stands in, at most 1: terms of a licence that many libraries carry count for little,
    a library that everybody carries under many names counts whole, and no line is left out. Lines in no
    library count 1. The containment of a file in a library is exact. Which pairs are to be compared is
    found by the file's rarest lines, just more than 1 - ``share`` of them; as none of the others weighs
    more, a library without any of these can't hold the share. A copy shares
    ``mass`` characters (by the same weights) with the library, or is shorter and stands whole in a
    library file of its own name. A file that is known itself is only compared with what other
    repositories (workspace_id, if there is one) hold of the library. Equal contents are indexed once.

    Lines that stand in more than 1 / ``hot`` of all contents, of which there can be no more than ``hot`` times
    the mean number of lines of a content, are looked up by broadcast; other joins that many copies of
    one library may meet in are salted. A side that has each row once for every salt is shuffled, never
    broadcast, so that nothing that grows with the files passes through the driver but what Spark's own limit allows.
    """
    repo = F.coalesce(F.col("workspace_id").cast("string"), F.lit("")) if "workspace_id" in files.columns else F.lit("")
    base = F.regexp_extract(F.regexp_replace(F.coalesce("path", F.lit("")), r"\\\\", "/"), r"([^/]*)$", 1)
    rows = files.where("content is not null and content != ''").select(F.col(key).alias("key"), repo.alias("repo"), F.regexp_replace(base, _VERSION.pattern, "").alias("base"), F.unhex(F.md5("content")).alias("text"), "content")
    named = known.where("library is not null").select(F.col(key).alias("key"), "library").distinct()
    places = durable(rows.select("key", "repo", "base", "text").join(named, "key", "left"))
    lines = durable(content_lines(rows.select("text", "content").dropDuplicates(["text"])))
    texts = places.groupBy("text").agg(F.min("repo").alias("low"), F.max("repo").alias("high"), F.max(F.col("library").isNotNull()).alias("is_known"))
    homes = places.where("library is not null").groupBy("text", "library").agg(F.min("repo").alias("low"), F.max("repo").alias("high"))
    index = durable(lines.join(homes, "text").groupBy("line", "library").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    frequency = index.groupBy("line").agg(F.count("*").alias("libraries"))
    index = index.join(frequency, "line")
    rarity = index.groupBy("library").agg(F.percentile_approx("libraries", 0.1, 1000).alias("usual"))
    # Frequent lines are looked up where they are, so that no task is sent all rows of one of them.
    number = texts.count()
    often = durable(lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") > max(1000, number / hot)).select("line").join(frequency, "line", "left"))
    seldom = lines.join(F.broadcast(often.select("line")), "line", "left_anti").join(frequency, "line", "left")
    weighed = seldom.unionByName(lines.join(F.broadcast(often), "line")).select("text", "line", "chars", F.coalesce("libraries", F.lit(0)).alias("libraries"))
    sums = weighed.groupBy("text").agg(F.count("*").alias("n"), F.count_if(F.col("libraries") > 0).alias("indexed"))
    # Only files whose lines stand to the share in libraries at all are looked at further.
    least = F.lit(share - 1e-9)
    asked = durable(weighed.join(sums.where(F.col("indexed") >= least * F.col("n")).select("text", "n"), "text"))
    place = F.row_number().over(W.partitionBy("text").orderBy("libraries", "line"))
    rarest = asked.withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(least * F.col("n")) + 1) & (F.col("libraries") > 0))
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(salts)).cast("int"))
    # Spark's estimates leave out that a row for each salt is made, so what holds one is never to be broadcast.
    each_salt = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    index = index.select("line", "library", "low", "high")
    pairs = salted(rarest.select("text", "line")).join(each_salt(index.select("line", "library")), ["line", "salt"]).select("text", "library").distinct().join(rarity, "library")
    weight = F.least(F.lit(1.0), F.col("usual") / F.greatest("libraries", F.lit(1)))
    both = salted(asked.join(pairs, "text")).join(each_salt(index), ["line", "library", "salt"], "left").join(texts.select("text", "is_known", F.col("low").alias("own_low")), "text").withColumn("weight", weight)
    elsewhere = F.col("low").isNotNull() & (~F.col("is_known") | (F.col("low") != F.col("own_low")) | (F.col("high") != F.col("own_low")))
    sides = both.groupBy("text", "library").agg(F.sum("weight").alias("whole"), F.sum(F.when(elsewhere, F.col("weight")).otherwise(0.0)).alias("held"), F.sum(F.when(elsewhere, F.col("weight") * F.col("chars")).otherwise(0.0)).alias("mass"))
    held = sides.where(F.col("held") >= least * F.col("whole"))
    held = held.select("text", "library", F.round(F.col("held") / F.col("whole"), 9).alias("containment"), "mass")
    library_base = F.regexp_extract(F.regexp_replace("library", r"#.*$", ""), r"([^/]*)$", 1)
    # A file whose copies are most rows meets its verdicts in salted portions.
    found = places.select("key", "base", "text").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(each_salt(held), ["text", "salt"])
    found = found.where((F.col("mass") >= mass) | ((F.col("containment") == 1.0) & (F.col("base") == library_base)))
    best = found.groupBy("key").agg(F.max(F.struct("containment", "library")).alias("b"))
    return best.select(F.col("key").alias(key), "b.library", "b.containment")


def file_evidence(files: DataFrame, key: str = "diff_id", folder: str = transducer.FOLDER, name: str = transducer.NAME) -> DataFrame:
    """All evidence on each file: ``key``, path_kind, head_kind, copy_of, containment, body_kind and reason, null where nobody speaks against it.

    The reason is the first of path, header, copy and composition that speaks. Rows with a null content
    count by their path alone. Repeated keys give repeated rows.
    """
    said = durable(evidence(files, key, folder, name))
    known = said.where("library is not null").select(key, "library")
    copies = contained_copies(files, known, key).select(key, F.col("library").alias("copy_of"), "containment")
    reason = F.coalesce("path_kind", "head_kind", F.when(F.col("copy_of").isNotNull(), "copied"), "body_kind")
    return said.join(copies, key, "left").select(key, "path_kind", "head_kind", "copy_of", "containment", "body_kind", reason.alias("reason"))


def not_hand_written(files: DataFrame, key: str = "diff_id", folder: str = transducer.FOLDER, name: str = transducer.NAME) -> DataFrame:
    """The files that nobody wrote by hand, with their evidence (see ``file_evidence``)."""
    return file_evidence(files, key, folder, name).where("reason is not null")
