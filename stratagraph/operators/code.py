"""Likeness of units of code: signatures of their shape, clones, hashed vectors, and searches with both."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import similar
from stratagraph.operators.graph import components
from stratagraph.session import durable

#: Words that keep their meaning in a unit's shape; all other names count as one.
KEYWORDS = frozenset("const let var function fn def func return if else elif for while do switch case class interface struct enum import from export public private protected static async await new this self super try catch finally throw throws void true false null nil none and or not in is as with yield lambda match when where type impl trait module end then begin using namespace package extends implements override virtual abstract final val mut pub use mod defer go select map range break continue default".split())
_TOKEN = re.compile(r"[a-z_$][\w$]*|\d+(?:\.\d+)?|[{}()\[\];,.+\-*/%=<>!&|^~?:]")


def shape_tokens(text: str) -> list[str]:
    """Tokens of code without its names and numbers."""
    return [("$n" if w[0].isdigit() else w if not (w[0].isalpha() or w[0] in "_$") or w in KEYWORDS else "$id") for w in _TOKEN.findall(text.lower())]


def shape_shingles(text: str, k: int = 3) -> set[str]:
    """Distinct runs of k tokens; a shorter text is one run, an empty one none."""
    words = shape_tokens(text)
    return {" ".join(words)} if 0 < len(words) < k else {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def fnv1a(text: str, seed: int = 0) -> int:
    """32-bit FNV-1a over UTF-16 code units, offset xor ``seed``."""
    h = 2166136261 ^ seed
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    return h


def signature(shingles: set[str], hashes: int = 64) -> np.ndarray:
    """For each seed the least hash over the shingles; all bits set for none."""
    least = np.full(hashes, 0xFFFFFFFF, np.uint64)
    for text in shingles:
        h = (np.full(hashes, 2166136261, np.uint64) ^ np.arange(hashes, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
        for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():
            h = ((h ^ np.uint64(unit)) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
        least = np.minimum(least, h)
    return least


def signatures(units: DataFrame, key: str, text: str, hashes: int = 64) -> DataFrame:
    """``key`` and sketch (array of ``hashes`` numbers) of each unit with text; null and token-free texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            keys, sketches = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if content is None:
                    continue
                if content not in known:
                    known[content] = signature(s, hashes).tolist() if (s := shape_shingles(content)) else []
                if known[content]:
                    keys.append(name)
                    sketches.append(known[content])
                if len(known) > 50_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(sketches, pa.list_(pa.int64()))], names=["key", "sketch"])

    schema = f"key {units.schema[key].dataType.simpleString()}, sketch array<bigint>"
    return units.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def clones(units: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """``key``, class_id and links of units whose shapes are alike: exact Jaccard similarity of their shingles of ``threshold`` or more.

    Units of equal shape are one text; between different shapes all pairs that reach the threshold are found
    (prefix filter, see ``similar``), so no clone is lost to chance. Classes are connected components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else sorted(shape_shingles(x)) or None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.string()))], names=["key", "runs"])

    schema = f"key {units.schema[key].dataType.simpleString()}, runs array<string>"
    runs = units.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).where("runs is not null")
    shaped = durable(runs.select("key", F.md5(F.concat_ws("\n", "runs")).alias("text_hash"), F.transform("runs", lambda r: F.xxhash64(r)).alias("shingles")))
    distinct = durable(shaped.select("text_hash", "shingles").dropDuplicates(["text_hash"]))
    pairs = durable(similar.similar_pairs(distinct, threshold))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("text_hash")).groupBy("text_hash").agg(F.count("*").alias("links"))
    named = components(pairs.select(F.col("a").alias("source"), F.col("b").alias("target"))).withColumnsRenamed({"id": "text_hash", "component": "class_id"})
    out = shaped.select("key", "text_hash").join(named, "text_hash", "left").join(ends, "text_hash", "left")
    return out.select(F.col("key").alias(key), F.coalesce("class_id", "text_hash").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def hashed_vector(text: str, width: int = 256) -> np.ndarray:
    """A text as a unit vector by feature hashing: tokens in lower case of two signs or more, scopes and values of 'scope:value' by weight."""
    vector = np.zeros(width)
    for token in re.sub(r"[^a-z0-9_:/.-]+", " ", text.lower()).split():
        if len(token) < 2:
            continue
        parts = [(token, 1.0)]
        if ":" in token:
            scope, value = token.split(":")[:2]
            parts += [(scope, 0.7), (value, 0.9)] if scope and value else []
        for part, weight in parts:
            vector[fnv1a(part) % width] += weight * (1 if fnv1a(f"sign:{part}") % 2 == 0 else -1)
    norm = np.linalg.norm(vector)
    return vector / norm if norm else vector


def embedded(rows: DataFrame, key: str, text: str, width: int = 256) -> DataFrame:
    """``key`` and embedding of each row's text; null texts have none. Stands for any provider of vectors behind the same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, x in enumerate(batch.column(1)) if x.as_py() is not None]
            vectors = [hashed_vector(batch.column(1)[i].as_py(), width).tolist() for i in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(vectors, pa.list_(pa.float32()))], names=["key", "embedding"])

    schema = f"key {rows.schema[key].dataType.simpleString()}, embedding array<float>"
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def semantic_search(vectors: DataFrame, lexical: DataFrame, query: str, key: str, k: int = 20, width: int = 256) -> DataFrame:
    """``key``, score: the best k of a search by vectors and one by words, fused by their ranks.

    ``vectors`` has key and embedding, ``lexical`` key and rank (from 0) of hits by words. The vector arm
    gives its first 3k by cosine, the word arm its first 3k; 1 / (61 + rank) is added up and scaled so that the
    best has 1. A query without tokens has only the word arm.
    """
    asked = hashed_vector(query, width)
    arm = lexical.select(key, "rank").where(F.col("rank") < 3 * k)
    parts = arm.select(key, (F.lit(1.0) / (F.col("rank") + 61)).alias("part"))
    if asked.any():
        wanted = F.array(*(F.lit(float(x)) for x in asked))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        scored = vectors.select(key, F.round(dot(F.col("embedding"), wanted), 9).alias("cosine")).where("cosine > 0").orderBy(F.col("cosine").desc(), key).limit(3 * k)
        from pyspark.sql import Window as W

        place = F.row_number().over(W.orderBy(F.col("cosine").desc(), key)) - 1  # at most 3k rows
        parts = parts.unionByName(scored.select(key, (F.lit(1.0) / (place + 61)).alias("part")))
    fused = parts.groupBy(key).agg(F.sum("part").alias("rrf")).orderBy(F.col("rrf").desc(), key).limit(k)
    return fused.select(key, F.round(F.col("rrf") / fused.agg(F.max("rrf")).scalar(), 6).alias("score"))
