"""SQL sources: SQLite and DuckDB files, JDBC databases, Flight SQL, Iceberg REST catalogs."""

from __future__ import annotations

import os
import sqlite3
import time
import urllib.parse
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon import types as kinds
from quillon.config import SourceConfig, TableConfig
from quillon.errors import Code, make
from quillon.sources.base import SourceProvider, Table, schema_of
from quillon.sources.datasource import quote, register


def _path(config: SourceConfig) -> str:
    path = config.options.get("connection") or config.options.get("path") or config.url
    if not path:
        raise make(Code.INVALID_CONNECTION_STRING, f"source '{config.name}' needs a connection")
    path = path.removeprefix("sqlite://").removeprefix("duckdb://")
    if not os.path.exists(path):
        raise make(Code.DATABASE_ERROR, f"source '{config.name}': no file {path}")
    return path


class _FileDatabase(SourceProvider):
    """A database in one file, read by executors that can open it."""

    def context(self, config: SourceConfig) -> Any:
        return (self.dialect, os.path.realpath(_path(config)))

    def introspect(self, path: str) -> dict[str, T.StructType]:
        raise NotImplementedError

    def schema_of_query(self, path: str, sql: str) -> T.StructType:
        raise NotImplementedError

    def tables(self, spark: SparkSession, config: SourceConfig) -> list[Table]:
        register(spark)
        path = _path(config)
        found = self.introspect(path)
        wanted = config.tables or [TableConfig(n) for n in found]
        out = []
        for t in wanted:
            actual = found.get(t.name)
            if actual is None:
                raise make(Code.TABLE_NOT_FOUND, f"source '{config.name}' has no table '{t.name}'", tables=list(found))
            out.append(Table(schema_of(config, t.schema), t.name, lambda t=t, s=actual: self._scan(spark, config, path, s, t), kinds.declared(t.columns), remote=t.name))
        return out

    def _scan(self, spark: SparkSession, config: SourceConfig, path: str, schema: T.StructType, t: TableConfig) -> DataFrame:
        reader = spark.read.format("quillon_sql").schema(schema).option("engine", self.dialect).option("path", path).option("table", quote(t.name))
        if t.partition_column:
            reader = reader.option("partitionColumn", t.partition_column).option("numPartitions", str(config.options.get("num_partitions", 8)))
        return reader.load()

    def run_remote(self, spark: SparkSession, config: SourceConfig, sql: str, schema: T.StructType) -> DataFrame:
        register(spark)
        path = _path(config)
        names = self.schema_of_query(path, sql).names  # the database refuses here what it cannot run
        if names != schema.names:
            raise make(Code.DATABASE_ERROR, f"source '{config.name}' answers with {names}")
        return spark.read.format("quillon_sql").schema(schema).option("engine", self.dialect).option("path", path).option("query", sql).load()


class SqliteProvider(_FileDatabase):
    type_name, dialect = "sqlite", "sqlite"

    def introspect(self, path: str) -> dict[str, T.StructType]:
        with sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro", uri=True) as db:
            names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
            out = {n: T.StructType([T.StructField(c[1], kinds.from_sqlite(c[2]), True) for c in db.execute(f"PRAGMA table_info({quote(n)})")]) for n in names}
        return out

    def schema_of_query(self, path: str, sql: str) -> T.StructType:
        """Types of a statement's columns by a temporary view; what has no declared type goes by its first value."""
        with sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro", uri=True) as db:
            db.execute(f"CREATE TEMP VIEW __quillon AS {sql}")
            columns = [(c[1], c[2]) for c in db.execute("PRAGMA table_info(__quillon)")]
            first = db.execute("SELECT * FROM __quillon LIMIT 1").fetchone() or [None] * len(columns)
        by_value = {int: T.LongType(), float: T.DoubleType()}
        return T.StructType([T.StructField(n, kinds.from_sqlite(k) if k else by_value.get(type(v), T.StringType()), True) for (n, k), v in zip(columns, first, strict=True)])


class DuckdbProvider(_FileDatabase):
    type_name, dialect = "duckdb", "duckdb"

    def introspect(self, path: str) -> dict[str, T.StructType]:
        import duckdb

        with duckdb.connect(path, read_only=True) as db:
            rows = db.execute("SELECT table_name, column_name, data_type, is_nullable FROM information_schema.columns WHERE table_schema = 'main' ORDER BY table_name, ordinal_position").fetchall()
        out: dict[str, list] = {}
        for t, c, k, n in rows:
            out.setdefault(t, []).append(T.StructField(c, kinds.from_duckdb(k), n == "YES"))
        return {t: T.StructType(f) for t, f in out.items()}

    def schema_of_query(self, path: str, sql: str) -> T.StructType:
        import duckdb

        with duckdb.connect(path, read_only=True) as db:
            return T.StructType([T.StructField(r[0], kinds.from_duckdb(r[1]), True) for r in db.execute(f"DESCRIBE {sql}").fetchall()])


#: Dialects over JDBC: URL scheme, default port, driver class.
JDBC = {"postgres": ("postgresql", 5432, "org.postgresql.Driver"), "mysql": ("mysql", 3306, "com.mysql.cj.jdbc.Driver"), "clickhouse": ("clickhouse", 8123, "com.clickhouse.jdbc.ClickHouseDriver")}

#: Statements that list (table, comment) of a database.
INTROSPECT = {
    "postgres": "SELECT c.relname AS table_name, obj_description(c.oid) AS comment FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname = 'public' AND c.relkind = 'r'",
    "mysql": "SELECT table_name, table_comment AS comment FROM information_schema.tables WHERE table_schema = DATABASE() AND table_type = 'BASE TABLE'",
    "clickhouse": "SELECT name AS table_name, comment FROM system.tables WHERE database = currentDatabase()",
}


def jdbc_options(config: SourceConfig, dialect: str) -> dict[str, str]:
    """Reader options of a connection URL such as postgres://user:secret@host:port/database."""
    raw = config.options.get("connection") or config.url
    if not raw:
        raise make(Code.INVALID_CONNECTION_STRING, f"source '{config.name}' needs a connection")
    scheme, port, driver = JDBC[dialect]
    u = urllib.parse.urlparse(raw.removeprefix("jdbc:"))
    if not u.hostname:
        raise make(Code.INVALID_CONNECTION_STRING, f"source '{config.name}': no host in the connection")
    out = {"url": f"jdbc:{scheme}://{u.hostname}:{u.port or port}/{u.path.lstrip('/') or 'default'}" + (f"?{u.query}" if u.query else ""), "driver": driver, "fetchsize": str(config.options.get("fetch_size", 10_000))}
    user, password = config.username or (urllib.parse.unquote(u.username) if u.username else None), config.password or (urllib.parse.unquote(u.password) if u.password else None)
    return out | ({"user": user} if user else {}) | ({"password": password} if password else {})


class JdbcProvider(SourceProvider):
    """Postgres, MySQL and ClickHouse by Spark's JDBC source; the driver's jar is the deployment's to add."""

    def __init__(self, dialect: str, aliases: tuple[str, ...] = ()):
        self.type_name, self.dialect, self.aliases = dialect, dialect, aliases

    def context(self, config: SourceConfig) -> Any:
        o = jdbc_options(config, self.dialect)
        return (o["url"], o.get("user"))

    def _reader(self, spark: SparkSession, config: SourceConfig):
        return spark.read.format("jdbc").options(**jdbc_options(config, self.dialect))

    def tables(self, spark: SparkSession, config: SourceConfig) -> list[Table]:
        listed = config.tables or [TableConfig(r["table_name"]) for r in self._reader(spark, config).option("query", INTROSPECT[self.dialect]).load().collect()]
        return [Table(schema_of(config, t.schema), t.name, lambda t=t: self.scan(spark, config, t), kinds.declared(t.columns, kinds.from_postgres), remote=t.name) for t in listed]

    def scan_options(self, config: SourceConfig, t: TableConfig) -> dict[str, str]:
        o = config.options
        out = {"dbtable": t.name if t.schema in ("", "public") else f"{t.schema}.{t.name}", "pushDownAggregate": "true", "pushDownLimit": "true"}
        if t.partition_column and "lower_bound" in o and "upper_bound" in o:
            out |= {"partitionColumn": t.partition_column, "lowerBound": str(o["lower_bound"]), "upperBound": str(o["upper_bound"]), "numPartitions": str(o.get("num_partitions", 16))}
        return out

    def scan(self, spark: SparkSession, config: SourceConfig, t: TableConfig) -> DataFrame:
        return self._reader(spark, config).options(**self.scan_options(config, t)).load()

    def run_remote(self, spark: SparkSession, config: SourceConfig, sql: str, schema: T.StructType) -> DataFrame:
        answer = self._reader(spark, config).option("query", sql).load()
        return answer.select(*[answer[n].cast(f.dataType).alias(f.name) for n, f in zip(answer.columns, schema.fields, strict=True)])


class SqlProvider(SourceProvider):
    """``type: sql`` with a ``dialect``."""

    type_name = "sql"

    def __init__(self, by_dialect: dict[str, SourceProvider]):
        self.by = by_dialect

    def of(self, config: SourceConfig) -> SourceProvider:
        name = str(config.options.get("dialect", "")).lower()
        if name not in self.by:
            raise make(Code.UNSUPPORTED_SOURCE_TYPE, f"source '{config.name}': unsupported dialect '{name}'", dialects=sorted(self.by))
        return self.by[name]

    def tables(self, spark, config):
        return self.of(config).tables(spark, config)

    def context(self, config):
        return self.of(config).context(config)

    def dialect_of(self, config):
        return self.of(config).dialect

    def run_remote(self, spark, config, sql, schema):
        return self.of(config).run_remote(spark, config, sql, schema)


class FlightProvider(SourceProvider):
    """A Flight SQL server; each declared table is scanned by one statement, an endpoint a partition."""

    type_name, aliases = "flight_sql", ("flight",)

    def tables(self, spark: SparkSession, config: SourceConfig) -> list[Table]:
        register(spark)
        if not config.tables:
            raise make(Code.MISSING_FIELD, f"source '{config.name}': list its tables and columns")

        def scan(t: TableConfig) -> DataFrame:
            reader = spark.read.format("quillon_flight").schema(kinds.declared(t.columns)).option("url", config.url or config.options["url"]).option("query", f"SELECT * FROM {quote(t.name)}")
            token = config.options.get("token")
            return (reader.option("token", token) if token else reader).load()

        return [Table(schema_of(config, t.schema), t.name, lambda t=t: scan(t), None, remote=t.name) for t in config.tables]


def iceberg_conf(config: SourceConfig) -> dict[str, str]:
    """spark.sql.catalog.* settings of an Iceberg REST catalog; the runtime jar is the deployment's to add."""
    o, name = config.options, f"spark.sql.catalog.{config.name}"
    if not o.get("catalog_uri") or not o.get("warehouse"):
        raise make(Code.MISSING_FIELD, f"source '{config.name}' needs catalog_uri and warehouse")
    out = {name: "org.apache.iceberg.spark.SparkCatalog", f"{name}.type": "rest", f"{name}.uri": o["catalog_uri"], f"{name}.warehouse": o["warehouse"]}
    for key, conf in (("token", "token"), ("region", "client.region"), ("s3_endpoint", "s3.endpoint"), ("oauth_credential", "credential")):
        if o.get(key):
            out[f"{name}.{conf}"] = str(o[key])
    cache = o.get("cache") or {}
    return out | {f"{name}.cache.expiration-interval-ms": str(int(cache.get("table_ttl_secs", 300)) * 1000)}


def iceberg_version(o: dict, now_ms: int | None = None) -> str:
    """The clause of a ``version`` option: snapshot_id, timestamp (ms), tag or branch."""
    v = o.get("version") or {}
    if not v:
        return ""
    if len(v) != 1:
        raise make(Code.CONFIG_ERROR, "version takes one of snapshot_id, timestamp, tag, branch")
    (kind, value), now = next(iter(v.items())), now_ms or int(time.time() * 1000)
    if kind == "snapshot_id" and int(value) > 0:
        return f" VERSION AS OF {int(value)}"
    if kind == "timestamp" and 0 < int(value) <= now:
        return f" TIMESTAMP AS OF timestamp_millis({int(value)})"
    if kind in ("tag", "branch") and str(value):
        return " VERSION AS OF '" + str(value).replace("'", "''") + "'"
    raise make(Code.CONFIG_ERROR, f"bad version {v}")


class IcebergProvider(SourceProvider):
    type_name, aliases = "iceberg_rest", ("iceberg",)

    def tables(self, spark: SparkSession, config: SourceConfig) -> list[Table]:
        for k, v in iceberg_conf(config).items():
            spark.conf.set(k, v)
        space, at = config.options.get("namespace") or config.name, iceberg_version(config.options)
        listed = config.tables or [TableConfig(r["tableName"]) for r in spark.sql(f"SHOW TABLES IN `{config.name}`.`{space}`").collect()]
        return [Table(space, t.name, lambda t=t: spark.sql(f"SELECT * FROM `{config.name}`.`{space}`.`{t.name}`{at}"), kinds.declared(t.columns)) for t in listed]
