"""One registry of named queries: a Spark plan and, where SQL can say it, the DuckDB text it is held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expose(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temp views of the tables that ``sql`` names; a plan keeps the relation it was analysed with."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            load(spark, sf_dir, name).createOrReplaceTempView(name)


def sql_query(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """A query that is one SQL text; ``oracle`` where DuckDB needs other words for the same thing."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        expose(spark, sf_dir, spark_sql)
        return spark.sql(spark_sql)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, oracle or spark_sql


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add
