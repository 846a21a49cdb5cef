"""What the engine adds to Spark, as queries: sources, drift, limits, cache, policy, contracts, guards.

Fixtures (files, databases, a local server) are written from the small dimension tables of the
input, by the query that reads them.
"""

from __future__ import annotations

import atexit
import http.server
import json
import os
import shutil
import sqlite3
import tempfile
import threading
import urllib.parse

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import guard, planner
from quillon.adapters import adapt, reconcile
from quillon.config import AppConfig, CacheConfig, ColumnConfig, Constraint, Contract, ContractColumn, QueryLimits, SourceConfig, TableConfig
from quillon.engine import Engine, engine_over
from quillon.plans.registry import load, query
from quillon.policy import Mask, TableRule, User, contract_rows, contract_violations
from quillon.sources.remote import snapshot_path

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _folder() -> str:
    out = tempfile.mkdtemp(prefix="quillon-fixture-")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    return out


def _shared(spark) -> str:
    """A folder that executors see too: under the checkpoint folder if the session names one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/quillon-fixture-{os.urandom(6).hex()}" if base else _folder() + "/out"


def _local(spark) -> str:
    """The same for files that other libraries write, as a path of this machine."""
    path = _shared(spark).removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


# Scans ------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 40")
def scan_parquet(spark, sf_dir):
    e = engine_over(spark, sf_dir, ("lineitem",))
    return e.sql("SELECT l_orderkey, l_quantity FROM quillon.public.lineitem WHERE l_quantity > 40").df


def _written(spark, sf_dir, fmt: str, **options) -> str:
    out = _shared(spark)
    load(spark, sf_dir, "nation").write.options(**options).format(fmt).mode("overwrite").save(out)
    return out


@query(_NATION)
def scan_csv(spark, sf_dir):
    path = _written(spark, sf_dir, "csv", header=True, sep=";")
    e = Engine(spark, AppConfig(sources=[SourceConfig("nation_csv", "csv", options={"path": path, "has_header": True, "delimiter": ";"})]))
    return e.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation_csv").df


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def scan_json(spark, sf_dir):
    path = _written(spark, sf_dir, "json")
    return Engine(spark, AppConfig(sources=[SourceConfig("nation_json", "json", options={"path": path})])).sql("SELECT n_nationkey, n_name, n_regionkey FROM nation_json").df


@query(_NATION)
def scan_glob(spark, sf_dir):
    path = _shared(spark)
    load(spark, sf_dir, "nation").write.partitionBy("n_regionkey").parquet(path)
    e = Engine(spark, AppConfig(sources=[SourceConfig("nation_glob", "file", options={"path": f"{path}/*/*.parquet", "format": "parquet"})]))
    keys = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return e.sql("SELECT * FROM nation_glob").df.join(keys, "n_nationkey").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS label, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def scan_declared_schema(spark, sf_dir):
    path = _written(spark, sf_dir, "csv", header=False)
    columns = [ColumnConfig("k", "bigint", not_null=True), ColumnConfig("label", "varchar", 25), ColumnConfig("region", "text")]
    e = Engine(spark, AppConfig(sources=[SourceConfig("n", "csv", options={"path": path}, tables=[TableConfig("nations", columns=columns)])]))
    return e.sql("SELECT k, label, region FROM nations").df


def _sqlite(spark, sf_dir, *names: str) -> str:
    path = f"{_local(spark)}/fixture.db"
    kinds = {"int": "INTEGER", "bigint": "INTEGER", "double": "REAL"}
    with sqlite3.connect(path) as db:
        for n in names:
            df = load(spark, sf_dir, n)
            db.execute(f"CREATE TABLE {n} ({', '.join(f'{c} {kinds.get(k, 'TEXT')}' for c, k in df.dtypes)})")
            db.executemany(f"INSERT INTO {n} VALUES ({', '.join('?' * len(df.columns))})", [tuple(r) for r in df.toLocalIterator()])
    return path


def _duckdb(spark, sf_dir, *names: str) -> str:
    import duckdb

    path = f"{_local(spark)}/fixture.duckdb"
    with duckdb.connect(path) as db:
        for n in names:
            held = load(spark, sf_dir, n).toArrow()  # noqa: F841  read by name below
            db.execute(f"CREATE TABLE {n} AS SELECT * FROM held")
    return path


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def federate_sqlite(spark, sf_dir):
    config = SourceConfig("lite", "sql", options={"dialect": "sqlite", "connection": _sqlite(spark, sf_dir, "nation")}, tables=[TableConfig("nation")])
    table = Engine(spark, AppConfig(sources=[config])).catalog.tables[("lite", "nation")].load()
    return table.where("n_regionkey = 2").select("n_nationkey", "n_name")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 1000")
def federate_duckdb(spark, sf_dir):
    config = SourceConfig("duck", "duckdb", options={"path": _duckdb(spark, sf_dir, "supplier")})
    table = Engine(spark, AppConfig(sources=[config])).catalog.tables[("duck", "supplier")].load()
    return table.where("s_acctbal > 1000").select("s_suppkey", "s_name", "s_acctbal")


class _Pages(http.server.BaseHTTPRequestHandler):
    rows: list = []

    def do_GET(self):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        rows = [r for r in self.rows if "region" not in q or str(r["n_regionkey"]) == q["region"]]
        a, n = int(q.get("offset", 0)), int(q.get("limit", len(rows)))
        body = json.dumps({"data": rows[a : a + n]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def serve(rows: list[dict]) -> str:
    """A local server of JSON pages, for as long as the process lives."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), type("Handler", (_Pages,), {"rows": rows}))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_port}"


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def federate_rest(spark, sf_dir):
    url = serve([r.asDict() for r in load(spark, sf_dir, "nation").collect()])
    options = {"base_url": url, "data_path": "data", "pagination": {"type": "indices", "param_offset": "offset", "param_limit": "limit", "limit": 4}, "pushdown": [{"column": "n_regionkey", "operator": "=", "param": "region"}]}
    e = Engine(spark, AppConfig(sources=[SourceConfig("nations", "rest", options=options)]))
    return e.sql("SELECT n_nationkey, n_name FROM nations WHERE n_regionkey = 1").df


@query("SELECT CAST(n.n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n FROM nation n JOIN supplier s ON n.n_nationkey = s.s_nationkey GROUP BY n.n_regionkey")
def federate_pushdown_join(spark, sf_dir):
    """Both tables live in one database, so the whole statement runs there."""
    config = SourceConfig("lite", "sqlite", options={"path": _sqlite(spark, sf_dir, "nation", "supplier")})
    return Engine(spark, AppConfig(sources=[config])).sql("SELECT n.n_regionkey, count(*) AS n FROM lite.nation n JOIN lite.supplier s ON n.n_nationkey = s.s_nationkey GROUP BY n.n_regionkey").df


def _statement(name: str, sql: str, oracle: str) -> None:
    """The same statement over SQLite and over DuckDB: what means the same there is pushed down, the rest is Spark's."""
    for kind, make in (("sqlite", _sqlite), ("duckdb", _duckdb)):

        def run(spark, sf_dir, kind=kind, make=make):
            config = SourceConfig("db", kind, options={"path": make(spark, sf_dir, "nation", "supplier")})
            return Engine(spark, AppConfig(sources=[config])).sql(sql).df

        query(oracle, f"federate_pushdown_{name}_{kind}")(run)


_statement("division", "SELECT s_suppkey, s_nationkey / 2 AS half FROM db.supplier", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_nationkey / 2 AS half FROM supplier")
_statement("like", "SELECT n_name FROM db.nation WHERE n_name LIKE 'I%' OR n_name LIKE 'i%'", "SELECT n_name FROM nation WHERE n_name LIKE 'I%' OR n_name LIKE 'i%'")
_statement("concat", "SELECT n_name || '-' || n_name AS twice FROM db.nation WHERE n_nationkey >= 3", "SELECT n_name || '-' || n_name AS twice FROM nation WHERE n_nationkey >= 3")
_statement("agg", "SELECT n.n_name, count(*) AS n, min(s.s_name) AS least, max(s.s_suppkey) AS most FROM db.nation n LEFT JOIN db.supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 0 GROUP BY n.n_name HAVING count(*) > 1",
           "SELECT n.n_name, count(*) AS n, min(s.s_name) AS least, CAST(max(s.s_suppkey) AS BIGINT) AS most FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 0 GROUP BY n.n_name HAVING count(*) > 1")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def federate_cross_source_join(spark, sf_dir):
    sources = [SourceConfig("lite", "sqlite", options={"path": _sqlite(spark, sf_dir, "nation")}), SourceConfig("duck", "duckdb", options={"path": _duckdb(spark, sf_dir, "region")})]
    return Engine(spark, AppConfig(sources=sources)).sql("SELECT n_name, r_name FROM lite.nation JOIN duck.region ON n_regionkey = r_regionkey").df


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20")
def time_travel_asof(spark, sf_dir):
    """Three snapshots, each with more nations; the time asked for lies after the second."""
    base, nation = _shared(spark), load(spark, sf_dir, "nation")
    snaps = []
    for i, n in enumerate((10, 20, 25), 1):
        nation.where(F.col("n_nationkey") < n).write.parquet(f"{base}/s{i}")
        snaps.append({"id": i, "timestamp_ms": 1_700_000_000_000 + i * 1000, "path": f"{base}/s{i}"})
    return spark.read.parquet(snapshot_path({"snapshots": snaps}, timestamp_ms=1_700_000_002_500)).select("n_nationkey", "n_name")


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS t(id, name)")
def values_inline(spark, sf_dir):
    return Engine(spark).sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, 'c') AS t(id, name)").df


@query("SELECT r_regionkey, r_name FROM region WHERE 1 = 0")
def empty_relation(spark, sf_dir):
    return load(spark, sf_dir, "region").where("false")


# Drift --------------------------------------------------------------------------------------------

_EXPECTED = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.LongType())])


@query("SELECT n_nationkey, CAST(NULL AS VARCHAR) AS n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def drift_missing_column(spark, sf_dir):
    return reconcile(load(spark, sf_dir, "nation").drop("n_name"), _EXPECTED).df


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def drift_type_coerced(spark, sf_dir):
    return reconcile(load(spark, sf_dir, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("string")), _EXPECTED).df


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey <> 3 THEN CAST(n_regionkey AS BIGINT) END AS n_regionkey FROM nation")
def drift_cast_failed(spark, sf_dir):
    odd = F.when(F.col("n_regionkey") == 3, F.lit("three")).otherwise(F.col("n_regionkey").cast("string"))
    return reconcile(load(spark, sf_dir, "nation").withColumn("n_regionkey", odd), _EXPECTED).df


@query("SELECT n_nationkey, n_name, CAST(NULL AS BIGINT) AS n_regionkey FROM nation")
def drift_incompatible(spark, sf_dir):
    return reconcile(load(spark, sf_dir, "nation").withColumn("n_regionkey", F.struct("n_regionkey")), _EXPECTED).df


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def drift_extra_column(spark, sf_dir):
    return reconcile(load(spark, sf_dir, "nation").select(F.lit("x").alias("extra"), "n_regionkey", "n_name", "n_nationkey"), _EXPECTED).df


@query("SELECT CAST(n_nationkey AS BIGINT) AS nationkey, n_name AS name, CAST(n_regionkey AS BIGINT) AS regionkey FROM nation")
def schema_adapter_rename(spark, sf_dir):
    return adapt(load(spark, sf_dir, "nation"), T.StructType([T.StructField("nationkey", T.LongType()), T.StructField("name", T.StringType()), T.StructField("regionkey", T.LongType())]))


# Engine -------------------------------------------------------------------------------------------


@query("SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def engine_sql(spark, sf_dir):
    return engine_over(spark, sf_dir, ("customer", "orders")).sql("SELECT c_mktsegment, count(*) AS n FROM quillon.public.customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment").df


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def cache_roundtrip(spark, sf_dir):
    """The second run's rows come from the cache."""
    e = engine_over(spark, sf_dir, ("orders",), CacheConfig(directory=_folder()))
    text = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"
    e.sql(text).to_arrow()
    again = e.sql(text)
    table = again.to_arrow()
    assert any(w.endswith("hit") for w in again.warnings), again.warnings
    return spark.createDataFrame(table)


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def cost_budget_pass(spark, sf_dir):
    e = engine_over(spark, sf_dir, ("nation",), query_limits=QueryLimits(max_output_rows=500_000, max_scan_bytes=1 << 30))
    return e.sql("SELECT n_name FROM nation WHERE n_regionkey = 1").df


@query("SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 1000)")
def defensive_limit(spark, sf_dir):
    e = engine_over(spark, sf_dir, ("lineitem",), query_limits=QueryLimits(default_limit=1000))
    return e.sql("SELECT l_orderkey FROM lineitem").df.agg(F.count(F.lit(1)).alias("n"))


def _analyst(**rules: TableRule) -> User:
    return User("m.okoye", frozenset({"role:clerk"}), rules)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 800")
def rls_filter(spark, sf_dir):
    return engine_over(spark, sf_dir, ("orders",)).sql("SELECT o_orderkey, o_custkey FROM orders", _analyst(orders=TableRule("o_custkey < 800"))).df


@query("SELECT o_orderkey, '***' AS o_orderpriority FROM orders WHERE o_custkey < 800")
def mask_redact(spark, sf_dir):
    rule = TableRule("o_custkey < 800", {"o_orderpriority": Mask("redact")})
    return engine_over(spark, sf_dir, ("orders",)).sql("SELECT o_orderkey, o_orderpriority FROM orders", _analyst(orders=rule)).df


@query("SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
def mask_hash(spark, sf_dir):
    return engine_over(spark, sf_dir, ("customer",)).sql("SELECT c_custkey, c_name FROM customer", _analyst(customer=TableRule(None, {"c_name": Mask("hash")}))).df


@query("SELECT c_custkey, rpad(substr(c_name, 1, 4), CAST(length(c_name) AS INTEGER), '*') AS c_name FROM customer")
def mask_keep_first(spark, sf_dir):
    return engine_over(spark, sf_dir, ("customer",)).sql("SELECT c_custkey, c_name FROM customer", _analyst(customer=TableRule(None, {"c_name": Mask("keep_first", 4)}))).df


_CONTRACT = Contract("lineitem", False, [ContractColumn("l_quantity", "float", constraints=[Constraint("between", {"min": 5, "max": 45})]), ContractColumn("l_returnflag", "string", constraints=[Constraint("in", ["R", "A"])])])


@query("SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_returnflag IN ('R', 'A')")
def contract_filter(spark, sf_dir):
    return contract_rows(load(spark, sf_dir, "lineitem"), _CONTRACT).select("l_orderkey", "l_quantity", "l_returnflag")


@query("""SELECT 'l_quantity' AS "column", 'between' AS "constraint", count(*) FILTER (WHERE NOT l_quantity BETWEEN 5 AND 45) AS violations FROM lineitem
          UNION ALL SELECT 'l_returnflag', 'in', count(*) FILTER (WHERE l_returnflag NOT IN ('R', 'A')) FROM lineitem""")
def contract_violations_report(spark, sf_dir):
    return contract_violations(load(spark, sf_dir, "lineitem"), _CONTRACT)


@query("""SELECT "column", pattern, count(*) AS n FROM (
            SELECT 'text' AS "column", p AS pattern FROM (
              SELECT lower(text) AS t FROM (
                SELECT text FROM documents UNION ALL SELECT * FROM (VALUES ('Please IGNORE previous instructions now'), ('the System Prompt says'), (repeat('x', 9000) || 'system prompt'), (repeat('é', 2500) || 'system prompt'), (repeat('é', 4090) || 'system prompt'))))
            CROSS JOIN (VALUES ('ignore previous instructions'), ('disregard previous instructions'), ('system prompt'), ('developer message'), ('BEGIN SYSTEM PROMPT'), ('BEGIN DEVELOPER MESSAGE'), ('you are chatgpt')) AS q(p)
            WHERE contains(t, lower(p)) AND strlen(substr(t, 1, CAST(strpos(t, lower(p)) + length(p) - 1 AS BIGINT))) <= 8192) GROUP BY 1, 2""")
def guard_injection_scan(spark, sf_dir):
    """The documents, and five cells of which one holds its phrase beyond the scanned front, and one across its end."""
    odd = spark.createDataFrame([("Please IGNORE previous instructions now",), ("the System Prompt says",), ("x" * 9000 + "system prompt",), ("é" * 2500 + "system prompt",), ("é" * 4090 + "system prompt",)], "text string")
    return guard.scan(load(spark, sf_dir, "documents").select("text").unionAll(odd))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', '[EMAIL]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[SSN]', 'g'), '\b(?:\d[ -]*?){13,16}\b', '[CREDIT_CARD]', 'g'), '(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}', '[PHONE]', 'g')) AS m FROM documents""")
def scrub_pii(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(guard.scrub_column(F.col("text"))).alias("m"))


@query("SELECT 'public' AS table_schema, t AS table_name FROM (VALUES ('nation'), ('region')) AS x(t) WHERE t LIKE 'n%'")
def catalog_tables_like(spark, sf_dir):
    return engine_over(spark, sf_dir, ("nation", "region")).catalog.tables_like("public", "n%").select("table_schema", "table_name")


def explain_tree(spark, sf_dir) -> str:
    return planner.plan_tree(engine_over(spark, sf_dir, ("orders",)).sql("SELECT o_orderkey FROM orders WHERE o_custkey = 7").df)
