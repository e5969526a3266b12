"""Registry of runnable queries and their independent SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from slopeline.session import prepare

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


class Tables:
    """Lazy access to the parquet tables of one scale folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(tables) -> DataFrame``; ``views`` names the derived views the SQL reads."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        text = None
        if sql is not None:
            from slopeline.catalog.views import with_views
            text = with_views(views.split(), sql)
        QUERIES[name] = Query(name, fn, text)
        return fn

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name].run(Tables(prepare(spark), folder))
