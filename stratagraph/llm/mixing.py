"""Mixing of sources to target shares of tokens by temperature.

Between the target shares (exponent 0) and the sources' own token shares (exponent 1) lie mixtures with
weights target**(1 - a) * own**a, normalised. The exponent is bisected to the least one found at which no source
would have to be repeated more often than allowed (or to a wanted entropy); these weights times the
whole size are the budgets, which whole passes and part of one more pass over each source realise.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.llm import transducer
from stratagraph.llm.encoding import count_tokens


def document_tokens(documents: DataFrame, folder: str = transducer.FOLDER, name: str = transducer.NAME) -> DataFrame:
    """doc_id, source and tokens of the documents that have a source."""
    return count_tokens(documents.where("source is not null"), "text", ["doc_id", "source"], folder, name)


def source_tokens(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with their supply: source, target_share, max_repeats, documents, tokens.

    Equal texts under several ids all count; null and empty texts are documents of no tokens; sources
    that are null or not in ``targets`` are left out, and a target without documents has 0 tokens.
    Sums are combined map-side, so a source with most rows costs no task more.
    """
    sizes = counted.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return wanted.join(sizes, "source", "left").withColumns({"documents": F.coalesce("documents", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})


def tempered(tokens: dict[str, int], entropy: float | None = None, max_repeats: float | dict[str, float] | None = None, shares: dict[str, float] | None = None, rounds: int = 60) -> tuple[float, dict[str, float]]:
    """The exponent a in [0, 1], bisected, and weights shares**(1 - a) * tokens**a, normalised.

    Without ``shares`` all sources are wanted alike. With ``entropy`` (nats) the weights have that entropy (or
    the nearest that can be had); with ``max_repeats``, for all or for each source, they are the nearest to
    the wanted shares at which no source is repeated more often when the whole set has as many tokens
    as there are. At exponent 1 each source is given just once, so there are such weights. Sources
    without tokens, without a share or not to be given at all have weight 0. One number per source of a target
    table is handled here; the table's rows bound it.
    """
    most = max_repeats if isinstance(max_repeats, dict) else dict.fromkeys(tokens, math.inf if max_repeats is None else max_repeats)
    have = {s: t for s, t in tokens.items() if t > 0 and most[s] >= 1 and (shares is None or shares.get(s, 0) > 0)}
    total = sum(have.values())
    if not have:
        return 0.0, dict.fromkeys(tokens, 0.0)
    wanted = {s: 0.0 if shares is None else math.log(shares[s]) for s in have}

    def weights(a: float) -> dict[str, float]:
        raw = {s: (1 - a) * wanted[s] + a * math.log(t) for s, t in have.items()}
        top = max(raw.values())
        raw = {s: math.exp(x - top) for s, x in raw.items()}
        whole = sum(raw.values())
        return {s: r / whole for s, r in raw.items()}

    def allowed(a: float) -> bool:
        w = weights(a)
        if entropy is not None:
            return -sum(x * math.log(x) for x in w.values() if x) <= entropy
        return all(w[s] * total <= most[s] * t for s, t in have.items())

    low, high = 0.0, 1.0
    if allowed(low):
        high = low
    else:
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (low, middle) if allowed(middle) else (middle, high)
    found = weights(high)
    return high, {s: found.get(s, 0.0) for s in tokens}


def weighted(supply: DataFrame, entropy: float | None = None) -> DataFrame:
    """Adds total, short, exponent, weight and budget (tokens) to the sources of the targets.

    No max_repeats is no limit. A source is short if its target share of the total is more than its tokens times max_repeats: these are
    the sources that keep exponent 0 from being allowed, and one is enough for it. Targets are one row per source, so
    all of them are weighed together in one task.
    """
    schema = "source string, target_share double, max_repeats int, documents bigint, tokens bigint, total bigint, short boolean, exponent double, weight double, budget double"

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        tokens = {r["source"]: r["tokens"] for r in rows}
        shares = {r["source"]: r["target_share"] or 0.0 for r in rows}
        repeats = {r["source"]: math.inf if r["max_repeats"] is None else r["max_repeats"] for r in rows}
        total = sum(tokens.values())
        short = {s: shares[s] * total > float(repeats[s] * tokens[s]) for s in tokens}
        exponent, weights = tempered(tokens, entropy, repeats, shares)
        usable = sum(t for s, t in tokens.items() if weights[s] > 0)
        return pa.Table.from_pylist([{**r, "total": total, "short": short[r["source"]], "exponent": exponent, "weight": weights[r["source"]], "budget": weights[r["source"]] * usable} for r in rows], pa.schema([*table.schema, ("total", pa.int64()), ("short", pa.bool_()), ("exponent", pa.float64()), ("weight", pa.float64()), ("budget", pa.float64())]))

    slim = supply.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"), "documents", "tokens")
    return slim.groupBy().applyInArrow(run, schema)


def realise(counted: DataFrame, weights: DataFrame, block_rows: int = 4096, seed: int = 17) -> DataFrame:
    """The mixed set: doc_id, source, copies and tokens of each document that occurs in it at least once.

    A source is given its budget of tokens: whole passes over all its documents, then the documents of
    one more pass until the rest of the budget is used. Each pass goes over the source's documents in a
    permutation of its own (see ``in_order``); a permutation is cut into blocks of about ``block_rows`` documents by
    hash. Only sums per block are ordered per source, and only in the one block that the budget ends in
    are rows ordered, so a source with a third of all rows is never sorted in one task. A document is
    taken if the budget reaches its middle, so the rest is missed by at most half a document. ``copies``
    never exceeds max_repeats. Null doc_ids are ordered like any other value.
    """
    wanted = weights.where("budget > 0").select("source", "max_repeats", F.col("tokens").alias("supply"), "documents", "budget")
    rows = counted.select("doc_id", "source", "tokens").join(F.broadcast(wanted), "source")  # one row per target
    passes = F.least(F.floor(F.col("budget") / F.col("supply") + 1e-9), F.col("max_repeats").cast("long"))
    rows = rows.withColumns({"passes": passes, "blocks": F.ceil(F.col("documents") / block_rows)})
    rows = rows.withColumns({"rest": F.greatest(F.lit(0.0), F.col("budget") - F.col("passes") * F.col("supply")), "block": _block(seed, F.col("passes")), "place": _place(seed, F.col("passes"))})
    sums = rows.groupBy("source", "block").agg(F.sum("tokens").alias("in_block"))
    ahead = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_block").over(ahead), F.lit(0)))
    placed = rows.join(sums, ["source", "block"])
    inside = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_block") > F.col("rest"))
    whole = placed.where(~inside).withColumn("taken", (F.col("before") + F.col("in_block") <= F.col("rest")) & (F.col("rest") > 0))
    earlier = W.partitionBy("source").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    edge = placed.where(inside).withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(earlier), F.lit(0)) + F.col("tokens") / 2)
    edge = edge.withColumn("taken", F.col("at") <= F.col("rest")).drop("at")
    copies = F.least(F.col("passes") + F.col("taken").cast("long"), F.col("max_repeats").cast("long")).cast("int")
    return whole.unionByName(edge).withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "copies", "tokens")


def _name() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _block(seed: int, turn: Column) -> Column:
    """The block of a document in the permutation of a pass; needs ``blocks``."""
    return F.pmod(F.xxhash64(F.lit(seed), turn, _name()), F.col("blocks"))


def _place(seed: int, turn: Column) -> Column:
    """The place of a document within its block in the permutation of a pass."""
    return F.xxhash64(F.lit(seed + 1), turn, _name())


def in_order(mixed: DataFrame, weights: DataFrame, block_rows: int = 4096, seed: int = 17) -> DataFrame:
    """One row per copy: doc_id, source, pass, block and place. Sorted by source, pass, block and place, each pass is a permutation of its own."""
    sizes = weights.select("source", F.ceil(F.col("documents") / block_rows).alias("blocks"))
    copies = mixed.select("doc_id", "source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies").cast("bigint") - 1)).alias("pass")).join(F.broadcast(sizes), "source")  # one row per target
    return copies.select("doc_id", "source", "pass", _block(seed, F.col("pass")).alias("block"), _place(seed, F.col("pass")).alias("place"))


def reached_shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """What each source really has in the mixed set: source, target_share, weight, exponent, reached_share, mixed_tokens, most_copies, short."""
    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    table = weights.select("source", "target_share", "weight", "exponent", "short").join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    whole = F.sum("mixed_tokens").over(W.partitionBy())
    share = F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), whole.cast("double")), F.lit(0.0))
    return table.select("source", "target_share", "weight", "exponent", share.alias("reached_share"), "mixed_tokens", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "short")
