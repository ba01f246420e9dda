"""Registry of queries: a name, a builder over a catalog, and SQL where SQL can express it."""

from __future__ import annotations

from stratagraph.catalog import Catalog


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build, sql: str | None = None) -> None:
        self.queries[name] = lambda spark, root: build(Catalog(spark, root))
        if sql is not None:
            self.sql[name] = sql
