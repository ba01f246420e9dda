"""Names to DataFrames: Parquet tables of one directory, read lazily and only as far as a query needs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    """Resolves table names below ``root``; ``views`` adds derived tables by name."""

    def __init__(self, spark: SparkSession, root: str, views: dict[str, Callable[["Catalog"], DataFrame]] | None = None):
        self.spark, self.root, self.views = spark, root.rstrip("/"), dict(views or {})

    def __call__(self, name: str) -> DataFrame:
        if name in self.views:
            return self.views[name](self)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")
