"""Near-equal texts by exact set similarity with prefix filtering, and their classes; vectors most like given ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.operators.graph import components
from stratagraph.session import durable


def word_shingles(texts: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """(text_hash, shingles): 128-bit names and distinct word sequences of each distinct text; shorter texts are one shingle, blank ones none."""
    tokens = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    kept = texts.where(F.col(text).isNotNull()).select(F.md5(text).alias("text_hash"), tokens.alias("w")).dropDuplicates(["text_hash"]).where(F.size("w") > 0)
    grams = F.when(F.size("w") < words, F.array(F.concat_ws(" ", "w"))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (words - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice("w", i, F.lit(words)))))
    return kept.select("text_hash", F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))).alias("shingles"))


def similar_pairs(shingled: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) of distinct texts whose shingle sets have at least ``threshold`` Jaccard similarity.

    Exact: two such sets share a shingle among their rarest size - ceil(threshold * size) + 1 ones, so only
    these are joined, between sets whose sizes allow the threshold. Rare-first order keeps shingles that
    stand everywhere out of the join; verified pairs are intersected in full.
    """
    each = shingled.select("text_hash", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    # Shingles of one text only can't be shared, but they count as its rarest ones.
    ranked = each.join(counts, "s", "left").groupBy("text_hash", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("r"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1
    prefix = durable(ranked.select("text_hash", "n", F.explode(F.filter(F.slice("r", F.lit(1), keep.cast("int")), lambda x: x["df"] > 1)).alias("x")).select("text_hash", "n", F.col("x.s").alias("s")))
    a, b = prefix.toDF("a", "na", "s"), prefix.toDF("b", "nb", "s")
    candidates = a.join(b, "s").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    sets = shingled.select(F.col("text_hash").alias("a"), F.col("shingles").alias("sa"))
    both = candidates.join(sets, "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    similarity = shared / (F.size("sa") + F.size("sb") - shared)
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def similar_classes(texts: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """``key``, class_id and links of each text that is not blank: its class and its links to different texts.

    Classes are connected components over similar texts; copies of a text share its class and links, and
    a text without links is a class of its own.
    """
    shingled = durable(word_shingles(texts, key, text))
    pairs = durable(similar_pairs(shingled, threshold))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("text_hash")).groupBy("text_hash").agg(F.count("*").alias("links"))
    named = components(pairs.select(F.col("a").alias("source"), F.col("b").alias("target"))).withColumnsRenamed({"id": "text_hash", "component": "class_id"})
    own = texts.where(F.col(text).isNotNull()).select(key, F.md5(text).alias("text_hash")).join(shingled.select("text_hash"), "text_hash")
    joined = own.join(named, "text_hash", "left").join(ends, "text_hash", "left")
    return joined.select(key, F.coalesce("class_id", "text_hash").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def cosine_top(rows: DataFrame, key: str, vector: str, asks: Column, k: int, block: int = 4096) -> DataFrame:
    """query_id, ``key`` and score (cosine, 6 decimals): the k rows most like each row for which ``asks`` holds, itself among them.

    Exact: blocks of queries meet blocks of all rows of the same length, and each pair of blocks keeps k rows
    per query. Vectors that are null, all zero or not finite take no part. Ties go to the smaller key.
    """
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    usable = rows.where(F.col(key).isNotNull() & good).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("width"), F.coalesce(asks, F.lit(False)).alias("asks"))
    sizes = usable.agg(F.count("*").alias("rows"), F.count_if("asks").alias("asks")).first()
    row_cuts, ask_cuts = (F.lit(max(1, -(-n // block))) for n in (sizes["rows"], sizes["asks"]))
    place = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    base = usable.select("key", "v", "width", place(row_cuts, 1).alias("row_cut")).withColumn("ask_cut", every(ask_cuts))
    asked = usable.where("asks").select("key", "v", "width", place(ask_cuts, 2).alias("ask_cut")).withColumn("row_cut", every(row_cuts))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            sides = [x.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, -1) for x in (left, right)]
            # Scaling first keeps squares finite.
            units = [x / np.abs(x).max(axis=1, keepdims=True) for x in sides]
            units, queries = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in units)
            ids, names = left.column("key").to_numpy(), right.column("key").to_numpy()
            for q, name in zip(queries, names):
                score = np.round(units @ q, 6) + 0.0
                first = np.lexsort((ids, -score))[:k]
                out.append((np.full(len(first), name), ids[first], score[first]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), key: pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    by = ["width", "row_cut", "ask_cut"]
    found = base.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, f"query_id bigint, {key} bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), key))
    return found.withColumn("place", rank).where(F.col("place") <= k).drop("place")
