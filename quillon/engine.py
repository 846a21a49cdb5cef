"""The federated engine: sources, catalog, policy, limits, cache and execution around one session."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon import guard as guards
from quillon import planner
from quillon.adapters import CircuitBreaker, Drift, Slots, reconcile, with_retry
from quillon.cache import ResultCache, cache_key
from quillon.catalog import Catalog, view_name
from quillon.config import AppConfig, CacheConfig, SourceConfig, redacted
from quillon.dialects import DIALECTS
from quillon.errors import Code, EngineError, from_spark, make
from quillon.functions.compat import rewrite_sql
from quillon.policy import User, enforce
from quillon.pushdown import Unsupported, remote_sql
from quillon.sources.base import Registry, SourceProvider
from quillon.sources.registry import default_registry


@dataclass
class QueryResult:
    """A lazy frame and its warnings; ``to_arrow`` runs it under the engine's limits."""

    engine: Engine
    df: DataFrame
    sql: str
    warnings: list[str]
    user: User | None = None
    drifts: list[Drift] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    _table: pa.Table | None = None

    @property
    def schema(self):
        return self.df.schema

    def to_arrow(self) -> pa.Table:
        if self._table is None:
            self._table = self.engine.execute(self)
        return self._table

    def to_pandas(self):
        return self.to_arrow().to_pandas()


class Engine:
    """One engine over a Spark session.

    ``rules`` are rewrites DataFrame -> DataFrame that run on every query, after the policy views.
    Without ``pushdown`` no statement is handed to a source whole.
    A source that fails to register is kept in ``catalog.errors``; the others start.
    """

    def __init__(self, spark: SparkSession, config: AppConfig | None = None, registry: Registry | None = None, providers: list[SourceProvider] = (), rules: list[Callable[[DataFrame], DataFrame]] = (), pushdown: bool = True):
        self.pushdown = pushdown
        self.spark, self.config = spark, config or AppConfig()
        self.registry = registry or default_registry()
        for p in providers:
            self.registry.add(p)
        self.rules = list(rules)
        self.catalog = Catalog(spark, self.config.catalog)
        self.cache = ResultCache(self.config.cache)
        self.slots = Slots(self.config.query_limits.max_concurrent)
        self.active, self._lock = 0, threading.Lock()
        self.sources: dict[str, SourceConfig] = {}
        self.breakers: dict[str, CircuitBreaker] = {}
        self.source_slots: dict[str, Slots] = {}
        self.table_rows: dict[str, int] = {}
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(self._try_register, self.config.sources))

    # Sources ----------------------------------------------------------------------------------

    def _try_register(self, source: SourceConfig) -> None:
        try:
            with_retry(lambda: self.register(source), self.config.retry if source.type not in ("file", "parquet", "csv", "json", "sqlite", "duckdb") else type(self.config.retry)(1))
        except Exception as e:
            self.catalog.errors[source.name] = e

    def register(self, source: SourceConfig) -> None:
        tables = self.registry.get(source.type).tables(self.spark, source)
        with self._lock:
            self.sources[source.name] = source
            self.breakers[source.name] = CircuitBreaker(source.name)
            self.source_slots[source.name] = Slots(source.max_concurrent_queries)
            for t in tables:
                self.catalog.add(source.name, t)
                n = t.rows()
                path = source.options.get("path") or source.url
                if n is not None and path:
                    self.table_rows[path] = n

    def list_sources(self) -> str:
        return json.dumps([redacted(asdict(s)) for s in self.sources.values()], default=str)

    def _table(self, key: tuple[str, str], user: User | None, drifts: list[Drift], warnings: list[str]) -> DataFrame:
        """A table as this user sees it: loaded behind its breaker, repaired, contracted, filtered, masked."""
        table, source = self.catalog.tables[key], self.catalog.source_of[key]
        df = self.breakers[source].call(table.load)
        if table.declared is not None and df.schema != table.declared:
            drift = reconcile(df, table.declared)
            drifts.append(drift)
            df = drift.df
        for contract in self.config.contracts:
            if contract.table.split(".")[-1] == key[1]:
                df = enforce(df, contract)
        rule = user.rule_for(*key) if user else None
        return rule.apply(df) if rule else df

    # Queries ------------------------------------------------------------------------------------

    def sql(self, query: str, user: User | None = None, params: dict | None = None) -> QueryResult:
        """A checked and planned query; nothing runs yet."""
        planner.check_read_only(query)
        prefix = f"q{uuid.uuid4().hex[:8]}_"
        drifts: list[Drift] = []
        warnings: list[str] = []
        try:
            text, used = self.catalog.rewrite(rewrite_sql(query), prefix)
            for key in used:
                self._table(key, user, drifts, warnings).createOrReplaceTempView(prefix + view_name(*key))
            if "information_schema__" in text:
                self.catalog.information_tables().createOrReplaceTempView("information_schema__tables")
                self.catalog.information_columns().createOrReplaceTempView("information_schema__columns")
            df = self.spark.sql(text, args=params) if params else self.spark.sql(text)
            pushed = self._pushed(query, df.schema, used, user, warnings) if self.pushdown and not params else None
            df = df if pushed is None else pushed
        except ValueError as e:
            raise make(Code.SYNTAX_ERROR, str(e)) from e
        except Exception as e:
            raise from_spark(e, self.catalog.names()) from e
        finally:
            for key in locals().get("used") or []:
                self.spark.catalog.dropTempView(prefix + view_name(*key))
        for rule in self.rules:
            df = rule(df)
        limits = self.config.query_limits
        sources = list(dict.fromkeys(self.catalog.source_of[k] for k in used))
        own = [self.sources[s].default_limit for s in sources if self.sources[s].default_limit]
        df, notes = planner.defensive_limit(df, min([x for x in (limits.default_limit, *own) if x], default=None))
        if limits.max_output_rows is not None or limits.max_scan_bytes is not None:
            planner.check_budget(df, limits.max_output_rows, limits.max_scan_bytes, self.table_rows)
        return QueryResult(self, df, query, warnings + notes, user, drifts, sources)

    def _pushed(self, query: str, schema, used: list[tuple[str, str]], user: User | None, warnings: list[str]) -> DataFrame | None:
        """The whole statement run by its source, if all its tables live in one database that takes statements.

        Tables with rules, contracts or a declared schema are read table by table, so that these
        hold; statements with a part that would mean something else there are Spark's. Names and
        types of the result are those that Spark gave the statement.
        """
        if not used:
            return None
        contexts = set()
        for key in used:
            s, t = self.sources[self.catalog.source_of[key]], self.catalog.tables[key]
            contracted = any(c.table.split(".")[-1] == key[1] for c in self.config.contracts)
            if t.remote is None or t.declared is not None or contracted or (user and user.rule_for(*key)):
                return None
            contexts.add(self.registry.get(s.type).context(s))
        if len(contexts) != 1 or None in contexts:
            return None
        source = self.sources[self.catalog.source_of[used[0]]]
        provider = self.registry.get(source.type)
        dialect = DIALECTS.get(provider.dialect_of(source))
        if dialect is None:
            return None

        def find(parts: list[str]):
            key = self.catalog.find(parts)
            return key and (self.catalog.tables[key].remote or key[1], key[1], self.catalog.tables[key].load().schema)

        try:
            remote = remote_sql(query, find, schema, dialect)
        except (Unsupported, EngineError):
            return None
        try:
            return self.breakers[source.name].call(lambda: provider.run_remote(self.spark, source, remote, schema))
        except Exception as e:  # the source does not take it: its tables are scanned
            warnings.append(f"x-quillon-pushdown: '{source.name}' did not take the statement ({type(e).__name__}: {str(e)[:200]}); its tables are scanned")
            return None

    def execute(self, result: QueryResult) -> pa.Table:
        limits, warnings = self.config.query_limits, result.warnings
        off = any((c := self.sources[s].cache) is not None and not c.enabled for s in result.sources)
        use_cache = self.cache.config.enabled and not off and planner.is_deterministic(result.df)
        key = cache_key(result.df, result.sql, result.user, limits) if use_cache else None
        if key:
            held = self.cache.get(key)
            warnings.append(f"x-quillon-cache: {'hit' if held is not None else 'miss'}")
            if held is not None:
                return held
        for s in result.sources:
            if not self.breakers[s].allow():
                raise make(Code.DATABASE_ERROR, f"Circuit breaker is OPEN for source '{s}'")
        with ExitStack() as held:
            for slots in (self.slots, *(self.source_slots[s] for s in result.sources)):
                held.enter_context(slots)
            with self._lock:
                self.active += 1
            try:
                table = self._run(result.df, limits.timeout_seconds)
            except Exception as e:
                for s in result.sources:
                    self.breakers[s].record(False)
                raise from_spark(e, self.catalog.names()) from e
            finally:
                with self._lock:
                    self.active -= 1
        for s in result.sources:
            self.breakers[s].record(True)
        for d in result.drifts:
            warnings.extend(d.warnings(result.df))
        if key:
            self.cache.put(key, table)
        return table

    def _run(self, df: DataFrame, seconds: float) -> pa.Table:
        """The action under a job tag that a timer cancels."""
        tag, late = f"quillon-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        timer.daemon = True
        self.spark.sparkContext.addJobTag(tag)
        self.spark.sparkContext.setInterruptOnCancel(True)
        timer.start()
        try:
            return df.toArrow()
        except Exception as e:
            if late.is_set():
                raise make(Code.QUERY_CANCELLED, f"query took more than {seconds} s", "narrow it or raise timeout_seconds") from e
            raise
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)

    def explain_tree(self, query: str, user: User | None = None) -> str:
        return planner.plan_tree(self.sql(query, user).df)

    def report(self, query: str, user: User | None = None) -> str:
        return planner.query_report(self.sql(query, user).df)

    def guarded(self, table: pa.Table, mode: str) -> list[str]:
        return guards.guard(table, mode)


def engine_over(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], cache: CacheConfig | None = None, **options) -> Engine:
    """An engine over Parquet tables of one directory, for queries and tests."""
    sources = [SourceConfig(t, "parquet", options={"path": f"{sf_dir}/{t}.parquet"}) for t in tables]
    return Engine(spark, AppConfig(sources=sources, cache=cache or CacheConfig(enabled=False), **options))
