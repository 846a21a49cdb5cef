"""The connection that Python users hold: connect(), sql(), trace(), describe(), explain_tree()."""

from __future__ import annotations

import os
import re
import threading

import pyarrow as pa
from pyspark.sql import SparkSession

from quillon.config import load_config
from quillon.engine import Engine
from quillon.errors import Code, make
from quillon.policy import User


class Connection:
    """A session's engine behind a lock; (async) context manager."""

    def __init__(self, engine: Engine, user: User | None = None, guard: str | None = None, tracer=None):
        self.engine, self.user, self.tracer = engine, user, tracer
        self.guard = guard or os.environ.get("QUILLON_GUARD_MODE", "disabled")
        self.warnings: list[str] = []
        self._lock, self._open = threading.Lock(), True

    def sql(self, query: str, params: dict | None = None) -> pa.Table:
        """Rows of a query as an Arrow table; an empty result keeps its schema. Named parameters bind :name."""
        with self._lock:
            if not self._open:
                raise make(Code.INTERNAL_STATE, "the connection is closed")
            result = self.engine.sql(query, self.user, params)
            table = result.to_arrow()
            self.warnings = result.warnings + self.engine.guarded(table, self.guard)
            if self.tracer:
                self.tracer.emit("query", sql=query, rows=table.num_rows, warnings=self.warnings)
            return table

    execute = sql

    def trace(self, query: str) -> str:
        """The plan of a query, without running it."""
        return self.engine.sql(query, self.user).df._jdf.queryExecution().toString()

    def describe(self, table: str | None = None) -> str:
        if table is None:
            return self.engine.catalog.information_tables().select("table_schema", "table_name", "source").toPandas().to_string(index=False)
        if not re.fullmatch(r"[A-Za-z0-9_.]+", table):
            raise make(Code.SYNTAX_ERROR, f"not a table name: {table!r}")
        found = self.engine.catalog.find(table.split("."))
        if found is None:
            from quillon.errors import did_you_mean

            near = did_you_mean(table.split(".")[-1], [t for _, t in self.engine.catalog.tables])
            raise make(Code.TABLE_NOT_FOUND, f"no table '{table}'", f"did you mean '{near}'?" if near else None)
        t = self.engine.catalog.tables[found]
        return "\n".join(f"{f.name}\t{f.dataType.simpleString()}\t{'YES' if f.nullable else 'NO'}\t{f.metadata.get('comment', '')}".rstrip() for f in t.declared or t.load().schema)

    def list_sources(self) -> str:
        return self.engine.list_sources()

    def explain_tree(self, query: str) -> str:
        return self.engine.explain_tree(query, self.user)

    def report(self, query: str) -> str:
        return self.engine.report(query, self.user)

    def close(self) -> None:
        self._open = False

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    async def __aenter__(self) -> Connection:
        return self

    async def __aexit__(self, *_) -> None:
        self.close()


def connect(dsn: str = "quillon.yaml", sources_config: str | None = None, api_key: str | None = None, spark: SparkSession | None = None, user: User | None = None, trace_dir: str | None = None) -> Connection:
    """Embedded over a configuration file; remote over a Spark Connect URL (``sc://host:port``)."""
    if dsn.startswith("sc://"):
        remote = SparkSession.builder.remote(dsn + (f"/;token={api_key}" if api_key else "")).getOrCreate()
        return RemoteConnection(remote)
    config = load_config(dsn, sources_config)
    spark = spark or SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tracer = None
    if trace_dir:
        from quillon.tracing import Tracer

        tracer = Tracer(trace_dir)
    return Connection(Engine(spark, config), user, tracer=tracer)


class RemoteConnection:
    """Queries over Spark Connect: the server's catalog, limits and policy are the server's own."""

    def __init__(self, spark):
        self.spark = spark

    def sql(self, query: str, params: dict | None = None) -> pa.Table:
        return (self.spark.sql(query, args=params) if params else self.spark.sql(query)).toArrow()

    execute = sql

    def describe(self, table: str | None = None) -> str:
        return self.spark.sql(f"DESCRIBE {table}" if table else "SHOW TABLES").toPandas().to_string(index=False)

    def close(self) -> None:
        self.spark.stop()
