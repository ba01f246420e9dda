"""Links between repositories by what they share or use of each other, and the journeys that run along them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = ["type", "contract", "source_repo", "target_repo", "confidence"]


def shared(holds: DataFrame, kind: str, confidence: float) -> DataFrame:
    """Links between repositories that hold the same thing; ``holds`` has repo and contract.

    Every repository is linked with the least that holds the thing, so a thing that all hold gives as many
    links as repositories and not all their pairs; repositories are linked if they have the same hub.
    """
    distinct = holds.where("repo is not null and contract is not null").select("repo", "contract").distinct()
    hubs = distinct.groupBy("contract").agg(F.min("repo").alias("source_repo"))
    return distinct.join(hubs, "contract").where("repo <> source_repo").select(F.lit(kind).alias("type"), "contract", "source_repo", F.col("repo").alias("target_repo"), F.lit(confidence).alias("confidence"))


def used(uses: DataFrame, provides: DataFrame, kind: str, confidence: float) -> DataFrame:
    """Links from repositories that use a thing (repo, contract) to the one that provides it, if it is only one."""
    provider = provides.where("repo is not null and contract is not null").select("repo", "contract").distinct().groupBy("contract").agg(F.min("repo").alias("target_repo"), F.count("*").alias("n")).where("n = 1")
    return uses.select(F.col("repo").alias("source_repo"), "contract").where("source_repo is not null").distinct().join(provider, "contract").where("source_repo <> target_repo").select(F.lit(kind).alias("type"), "contract", "source_repo", "target_repo", F.lit(confidence).alias("confidence"))


def schemas_under_contract(schemas: DataFrame, links: DataFrame, least: float = 0.75) -> DataFrame:
    """Shared schemas (repo, contract, exact) of repositories that already have a link of ``least`` confidence; .93 if both are exact, else .81."""
    met = links.where(F.col("confidence") >= least).select("source_repo", "target_repo").distinct()
    one = schemas.groupBy("repo", "contract").agg(F.max("exact").alias("exact"))
    both = met.join(one.select(F.col("repo").alias("source_repo"), "contract", F.col("exact").alias("a")), "source_repo").join(one.select(F.col("repo").alias("target_repo"), "contract", F.col("exact").alias("b")), ["target_repo", "contract"])
    return both.select(F.lit("shared-schema").alias("type"), "contract", "source_repo", "target_repo", F.when(F.col("a") & F.col("b"), 0.93).otherwise(0.81).alias("confidence"))


def united(*links: DataFrame) -> DataFrame:
    """All links once, the most certain of each, with id and certainty: confirmed from .9, likely from .75, else possible."""
    everything = reduce(DataFrame.unionByName, [x.select(*LINK) for x in links])
    best = everything.groupBy("type", "contract", "source_repo", "target_repo").agg(F.max("confidence").alias("confidence"))
    certainty = F.when(F.col("confidence") >= 0.9, "confirmed").when(F.col("confidence") >= 0.75, "likely").otherwise("possible")
    return best.select(F.concat_ws(":", "type", "source_repo", "target_repo", "contract").alias("id"), *LINK, certainty.alias("certainty"))
