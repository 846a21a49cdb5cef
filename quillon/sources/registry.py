"""The providers that come with the engine."""

from __future__ import annotations

from quillon.sources.base import Registry
from quillon.sources.databases import DuckdbProvider, FlightProvider, IcebergProvider, JdbcProvider, SqliteProvider, SqlProvider
from quillon.sources.files import FileProvider
from quillon.sources.remote import GrpcProvider, RestProvider, SnapshotProvider


def default_registry() -> Registry:
    out = Registry()
    sqlite, duck = SqliteProvider(), DuckdbProvider()
    jdbc = {"postgres": JdbcProvider("postgres", ("postgresql",)), "mysql": JdbcProvider("mysql", ("mariadb",)), "clickhouse": JdbcProvider("clickhouse")}
    dialects = {"sqlite": sqlite, "duckdb": duck, **jdbc, "postgresql": jdbc["postgres"], "mariadb": jdbc["mysql"]}
    for p in (FileProvider(), sqlite, duck, *jdbc.values(), SqlProvider(dialects), FlightProvider(), IcebergProvider(), RestProvider(), GrpcProvider(), SnapshotProvider()):
        out.add(p)
    return out
