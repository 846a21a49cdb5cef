import http.server
import json
import threading
import urllib.error
import urllib.request

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import cli, guard, sandbox, server, streaming
from quillon.adapters import CircuitBreaker, Slots, TtlCache, adapt, reconcile, retry_delay_ms, with_retry
from quillon.config import AppConfig, ColumnConfig, RetrySettings, SourceConfig, TableConfig, build, expand_secrets, load_config, override, redacted
from quillon.dialects import DIALECTS, Bin, Case, Cast, Col, Fn, Lit, Select, check_identifier, render, route
from quillon.engine import engine_over
from quillon.errors import Code, EngineError, did_you_mean
from quillon.functions import compat
from quillon.metastore import Metastore, diff
from quillon.operators import distinct_on, nway_join, safe_broadcast, salted_join
from quillon.policy import User
from quillon.search import SchemaIndex, schema_details
from quillon.sources.databases import iceberg_conf, iceberg_version, jdbc_options
from quillon.sources.datasource import rest_pages
from quillon.sources.files import spark_path
from quillon.sources.registry import default_registry
from quillon.sources.remote import snapshot_path
from quillon.types import declared, from_duckdb, from_grpc, from_postgres, from_sqlite, from_yaml, infer_json


def code_of(f, *args, **kw):
    with pytest.raises(EngineError) as e:
        f(*args, **kw)
    return e.value.code


# Adapters -----------------------------------------------------------------------------------------


def test_breaker_states():
    now = [0.0]
    b = CircuitBreaker("s", clock=lambda: now[0])
    for ok in (True, True, False, False):
        b.record(ok)
    assert b.state == "closed"
    b.record(False)
    assert b.state == "open" and not b.allow()
    assert code_of(b.call, lambda: 1) is Code.DATABASE_ERROR
    now[0] = 31
    assert b.allow() and b.state == "half-open"
    b.record(True), b.record(True)
    assert b.state == "closed"
    for _ in range(4):
        b.record(False)
    now[0] += 301
    b.record(False)
    assert b.state == "closed"


def test_retry_and_slots():
    calls, slept = [], []

    def f():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert with_retry(f, RetrySettings(5, 100, 1000), slept.append) == "ok" and len(slept) == 2
    assert retry_delay_ms(2, RetrySettings(5, 100, 10_000), lambda: 0.5) == 900 and retry_delay_ms(20, RetrySettings(5, 100, 10_000)) == 10_000
    with pytest.raises(OSError):
        with_retry(lambda: (_ for _ in ()).throw(OSError()), RetrySettings(2, 1, 1), slept.append)
    s = Slots(1, 0.01)
    with s:
        assert code_of(s.__enter__) is Code.SLOT_UNAVAILABLE
    with Slots(0), Slots(0):
        pass


def test_ttl_cache():
    now = [0.0]
    c = TtlCache(10, 2, lambda: now[0])
    assert [c.get("a", lambda: 1), c.get("a", lambda: 2)] == [1, 1]
    now[0] = 11
    assert c.get("a", lambda: 3) == 3
    c.get("b", lambda: 1), c.get("c", lambda: 1)
    assert c.get("a", lambda: 9) == 9


KINDS = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "double": T.DoubleType()}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from(sorted(KINDS))), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.lists(st.sampled_from("abcdeF"), min_size=1, max_size=5, unique=True))
def test_drift_keeps_rows_and_gives_the_schema(spark, expected, actual):
    df = spark.range(3).select(*[F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise(F.lit("x")).alias(n) for n in actual])
    want = T.StructType([T.StructField(n, KINDS[k]) for n, k in expected])
    out = reconcile(df, want)
    assert out.df.count() == 3 and [(f.name, f.dataType) for f in out.df.schema] == [(n, KINDS[k]) for n, k in expected]
    assert sum("Missing" in w for w in out.known) == len({n for n, _ in expected} - set(actual))


def test_drift_names_match_by_case(spark):
    out = reconcile(spark.createDataFrame([(1,)], "A int"), T.StructType([T.StructField("a", T.IntegerType())]))
    assert out.df.first().a is None and len(out.known) == 2


def test_identity_columns_still_push_down(spark, sf):
    df = spark.read.parquet(f"{sf}/nation.parquet")
    out = reconcile(df, T.StructType([*df.schema.fields[:2], T.StructField("new", T.StringType())])).df.where("n_nationkey = 3")
    assert "EqualTo(n_nationkey,3)" in out._jdf.queryExecution().executedPlan().toString()


def test_schema_adapter_errors(spark):
    df = spark.createDataFrame([(1.5,)], "x_v double")
    assert code_of(adapt, df, T.StructType([T.StructField("v", T.LongType())])) is Code.TYPE_MISMATCH
    assert code_of(adapt, df, T.StructType([T.StructField("w", T.LongType())])) is Code.FIELD_NOT_FOUND


# Configuration, types, sources ------------------------------------------------------------------------


def test_config(tmp_path):
    assert expand_secrets("a ${X} ${Y}", {"X": "1"}) == "a 1 ${Y}"
    assert override({"cache": {}}, {"QUILLON_CACHE__TTL_SECONDS": "7", "OTHER": "x"})["cache"]["ttl_seconds"] == 7
    (tmp_path / "m.yaml").write_text("query_limits:\n  default_limit: 5\n")
    (tmp_path / "sources.yaml").write_text("domain: d\nsources:\n  - {name: a, type: rest, base_url: http://x, auth: {type: bearer, token: t}}\n")
    c = load_config(str(tmp_path / "m.yaml"), env={})
    assert c.query_limits.default_limit == 5 and c.domain == "d" and c.sources[0].options["base_url"] == "http://x"
    assert code_of(build, AppConfig, {"nope": 1}) is Code.SCHEMA_VIOLATION and code_of(build, SourceConfig, {"name": "a"}) is Code.MISSING_FIELD
    (tmp_path / "bad.yaml").write_text("a: [")
    assert code_of(load_config, str(tmp_path / "bad.yaml")) is Code.INVALID_YAML
    assert redacted({"password": "x", "n": [{"api_key": "y", "k": 1}]}) == {"password": "***", "n": [{"api_key": "***", "k": 1}]}


def test_type_maps():
    assert from_yaml("decimal").simpleString() == "decimal(15,2)" and from_yaml("timestamp").simpleString() == "string"
    assert from_postgres("numeric(10,2)").simpleString() == "double" and from_postgres("timestamp with time zone").simpleString() == "timestamp_ntz"
    assert [from_sqlite(x).simpleString() for x in ("BIGINT", "varchar(3)", "DOUBLE", "")] == ["bigint", "string", "double", "string"]
    assert from_duckdb("DECIMAL(10,2)").simpleString() == "decimal(10,2)" and from_duckdb("UBIGINT").simpleString() == "decimal(20,0)"
    assert code_of(from_grpc, "Date32") is Code.CONFIG_ERROR
    assert infer_json({"a": 1, "b": 1.5, "c": True, "d": None, "e": [1]}).simpleString() == "struct<a:bigint,b:double,c:boolean,d:string,e:string>"
    assert declared([ColumnConfig("a", "int", 4, not_null=True, comment="c")])[0].metadata == {"length": 4, "comment": "c"}


def test_connector_options():
    o = jdbc_options(SourceConfig("p", "postgres", options={"connection": "postgres://u:p%40@h/db?ssl=true"}), "postgres")
    assert o["url"] == "jdbc:postgresql://h:5432/db?ssl=true" and o["password"] == "p@"
    assert jdbc_options(SourceConfig("c", "clickhouse", url="http://h"), "clickhouse")["url"] == "jdbc:clickhouse://h:8123/default"
    assert code_of(jdbc_options, SourceConfig("c", "mysql"), "mysql") is Code.INVALID_CONNECTION_STRING
    conf = iceberg_conf(SourceConfig("ice", "iceberg", options={"catalog_uri": "http://c", "warehouse": "w", "token": "t", "cache": {"table_ttl_secs": 5}}))
    assert conf["spark.sql.catalog.ice.type"] == "rest" and conf["spark.sql.catalog.ice.cache.expiration-interval-ms"] == "5000"
    assert iceberg_version({"version": {"snapshot_id": 7}}) == " VERSION AS OF 7" and iceberg_version({"version": {"tag": "a'b"}}) == " VERSION AS OF 'a''b'"
    for bad in ({"snapshot_id": 0}, {"timestamp": 10}, {"branch": ""}, {"tag": "x", "branch": "y"}):
        assert code_of(iceberg_version, {"version": bad}, 5) is Code.CONFIG_ERROR
    reg = default_registry()
    assert reg.get("csv") is reg.get("file") and reg.get("iceberg").type_name == "iceberg_rest" and reg.get("mariadb").type_name == "mysql"
    assert spark_path("s3://b/k") == "s3a://b/k" and spark_path("gcs://b") == "gs://b"
    assert code_of(reg.get("grpc").tables, None, SourceConfig("g", "grpc")) is Code.MISSING_FIELD


def test_snapshots():
    m = {"snapshots": [{"id": 2, "timestamp_ms": 20, "path": "b"}, {"id": 1, "timestamp_ms": 10, "path": "a"}], "tags": {"v1": 1}}
    assert [snapshot_path(m), snapshot_path(m, timestamp_ms=19), snapshot_path(m, snapshot_id=2), snapshot_path(m, tag="v1")] == ["b", "a", "b", "a"]
    assert code_of(snapshot_path, m, timestamp_ms=5) is Code.CONFIG_ERROR and code_of(snapshot_path, m, tag="no") is Code.CONFIG_ERROR


class _Api(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        self.seen.append((self.path, self.headers.get("Authorization")))
        kind, _, n = self.path.strip("/").split("?")[0].partition("/")
        i = int(n or self.path.partition("t=")[2] or 0)
        base = f"http://127.0.0.1:{self.server.server_port}"
        body, head = {"items": [{"id": i}]}, {}
        if i < 2:
            body["next"] = f"{base}/body/{i + 1}" if kind == "body" else None
            body["meta"] = {"token": i + 1} if kind == "token" else {}
            head = {"Link": f'<{base}/link/{i + 1}>; rel="next"'} if kind == "link" else {}
        self.send_response(200)
        for k, v in head.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


def test_rest_pagination_and_auth():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Api)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"
    ids = lambda o: [r["id"] for p in rest_pages(o) for r in p]
    assert ids({"base_url": f"{base}/body", "pagination": {"type": "bodyurl", "path": "next"}}) == [0, 1, 2]
    assert ids({"base_url": f"{base}/link", "pagination": {"type": "header", "header_name": "Link"}}) == [0, 1, 2]
    assert ids({"base_url": f"{base}/token", "pagination": {"type": "token", "token_path": "meta.token", "param_name": "t"}}) == [0, 1, 2]
    assert ids({"base_url": f"{base}/body", "max_pages": 2, "pagination": {"type": "bodyurl", "path": "next"}}) == [0, 1]
    ids({"base_url": f"{base}/x", "auth": {"type": "basic", "username": "a", "password": "b"}})
    assert _Api.seen[-1][1] == "Basic YTpi"
    ids({"base_url": base, "path": "/y", "auth": {"type": "bearer", "token": "t"}})
    assert _Api.seen[-1] == ("/y", "Bearer t")
    s.shutdown()


# Functions, dialects, operators ------------------------------------------------------------------------


def test_rewrites():
    assert compat.rewrite_sql("SELECT strpos(a, 'log(x)'), log(b), log(2, b), \"concat\" FROM t -- trunc(x)") == "SELECT instr(a, 'log(x)'), log10(b), log(2, b), \"concat\" FROM t -- trunc(x)"
    assert compat.rewrite_sql("SELECT concat(a, concat(b, c))") == "SELECT concat_ws('', a, concat_ws('', b, c))"
    with pytest.raises(ValueError):
        compat.rewrite_sql("SELECT a + 1 FROM t QUALIFY row_number() OVER (ORDER BY a) = 1")


def test_rewritten_functions_run(spark):
    q = "SELECT trunc(-1.7) AS a, substr('hello', 0, 2) AS b, to_hex(255) AS c, array_to_string(make_array(1, 2), '-') AS d, sha256('x') = sha2('x', 256) AS e, log(100) AS f"
    r = spark.sql(compat.rewrite_sql(q)).first()
    assert (float(r.a), r.b, r.c, r.d, r.e, r.f) == (-1.0, "h", "ff", "1-2", True, 2.0)


def test_dataframe_operators(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (2, 9), (None, 1)], "k int, v int")
    assert sorted((r.k or 0, r.v) for r in distinct_on(df, ["k"], [F.col("v")]).collect()) == [(0, 1), (1, 3), (2, 9)]
    assert compat.qualify(df, F.row_number().over(compat.Window.partitionBy("k").orderBy(F.desc("v"))) == 1).count() == 3
    small = spark.createDataFrame([(1, "a"), (1, "b"), (7, "c")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, salted_join(df, small, "k", 4, how).collect())) == sorted(map(str, df.join(small, "k", how).collect()))
    assert nway_join(df, (small, ["k"], "left"), (small.withColumnRenamed("w", "z"), ["k"], "inner")).count() == 8
    n = spark.range(5).withColumnRenamed("id", "k")
    assert "broadcast" in safe_broadcast(n, 1 << 20)._jdf.queryExecution().toString().lower() and "broadcast" not in safe_broadcast(n, 1)._jdf.queryExecution().toString().lower()
    with pytest.raises(RuntimeError):
        compat.recursive_distinct(spark.createDataFrame([(1,)], "n int"), lambda d: d.select((F.col("n") + 1).alias("n")), 3)


def test_dialects():
    d = DIALECTS
    assert render(Bin("*", Bin("+", Col("a"), Col("b")), Col("c")), d["postgres"]) == '(("a" + "b") * "c")'
    assert render(Fn("coalesce", (Col("a"), Lit(0))), d["oracle"]) == 'NVL("a", 0)' and render(Fn("coalesce", (Col("a"), Col("b"), Lit(0))), d["oracle"]).startswith("COALESCE")
    assert render(Fn("position", (Lit("x"), Col("s"))), d["oracle"]) == "INSTR(\"s\", 'x')" and render(Fn("now"), d["snowflake"]) == "CURRENT_TIMESTAMP()"
    assert render(Fn("string_agg", (Col("n"), Lit(","))), d["oracle"]) == "LISTAGG(\"n\", ',') WITHIN GROUP (ORDER BY \"n\")"
    assert render(Fn("count", (Col("a"),), distinct=True, where=Bin(">", Col("b"), Lit(1))), d["postgres"]) == 'COUNT(DISTINCT "a") FILTER (WHERE ("b" > 1))'
    import datetime

    assert render(Lit(datetime.date(2024, 1, 2)), d["sqlite"]) == "DATE '2024-01-02'" and render(Cast(Col("a"), "bigint"), d["oracle"]) == 'CAST("a" AS NUMERIC(19))'
    q = Select("t", [(Col("k"), "k"), (Col("v"), "v")], distinct_on=[Col("k")], order_by=[(Col("v"), False, False)], limit=None)
    assert "DISTINCT ON" in q.sql(d["postgres"]) and "ROW_NUMBER() OVER" in q.sql(d["sqlite"])
    assert Select(None, [(Lit(1), "x")]).sql(d["oracle"]).endswith("FROM DUAL") and "FETCH FIRST 3" in Select("t", [(Col("a"), "a")], limit=3).sql(d["oracle"])
    for bad in ("", "a;b", 'a"b', "x" * 129):
        assert code_of(check_identifier, bad) is Code.SYNTAX_ERROR
    assert code_of(render, Bin("@@", Col("a"), Lit(1)), d["postgres"]) is Code.PUSHDOWN_UNSUPPORTED
    assert [route(x)[0] for x in ("postgresql", "oracle", "duckdb", "rest")] == ["native", "custom", "handoff", "local"]


@settings(max_examples=40, deadline=None)
@given(st.recursive(st.one_of(st.integers(-50, 50).map(Lit), st.just(Col("a")), st.just(Col("b"))), lambda e: st.tuples(st.sampled_from("+-*"), e, e).map(lambda t: Bin(*t)), max_leaves=12))
def test_rendered_arithmetic_round_trips(e):
    import sqlite3

    def value(x):
        if isinstance(x, Lit):
            return x.value
        return {"a": 3, "b": -7}[x.name] if isinstance(x, Col) else {"+": int.__add__, "-": int.__sub__, "*": int.__mul__}[x.op](value(x.left), value(x.right))

    want = value(e)
    if abs(want) < 1 << 60:
        db = sqlite3.connect(":memory:")
        db.execute("CREATE TABLE t AS SELECT 3 AS a, -7 AS b")
        got = db.execute(Select("t", [(Case(((Bin("=", Lit(1), Lit(1)), e),)), "v")]).sql(DIALECTS["sqlite"])).fetchone()[0]
        assert got == want or isinstance(got, float)


# Surfaces -----------------------------------------------------------------------------------------------


def test_scrub(spark):
    cases = {"email = 'test@example.com'": "email = '[EMAIL]'", "('123-45-6789')": "('[SSN]')", "number is 1234-5678-9012-3456.": "number is [CREDIT_CARD].", "Call me at 123-456-7890 or (555) 123-4567": "Call me at [PHONE] or [PHONE]"}
    for a, b in cases.items():
        assert guard.scrub(a) == b
    df = spark.createDataFrame([(a,) for a in cases], "t string")
    assert [r[0] for r in df.select(guard.scrub_column(F.col("t"))).collect()] == list(cases.values())


def test_guard_on_arrow_kinds():
    t = pa.table({"a": pa.array(["ok", "You are ChatGPT"], pa.large_string()), "b": pa.array(["begin system prompt", "x"]).dictionary_encode(), "c": [1, 2]})
    assert {(f.column, f.pattern) for f in guard.scan_arrow(t)} == {("a", "you are chatgpt"), ("b", "BEGIN SYSTEM PROMPT")}
    assert code_of(guard.guard, t, "odd") is Code.CONFIG_ERROR


def test_metastore(tmp_path):
    m = Metastore(str(tmp_path / "m.db"))
    one = {"sources": [{"name": "a", "type": "file", "tables": [{"name": "t", "columns": [{"name": "x", "type": "int"}]}]}]}
    two = {"sources": [{"name": "a", "type": "file", "tables": [{"name": "t", "columns": [{"name": "x", "type": "bigint"}]}]}, {"name": "b", "type": "rest"}]}
    assert m.apply("d", one, 0).version == 1 and m.apply("d", one).version == 1 and m.apply("d", two, dry_run=True).version == 2
    assert code_of(m.apply, "d", two, 0) is Code.CONFIG_ERROR
    assert m.apply("d", two, 1).version == 2 and m.rollback("d", 1).version == 3 and m.current("d").config == one and m.domains() == ["d"]
    assert diff(one, two) == ["+ source b", "~ column a.t.x"]


def test_cli(tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init", "--template", "rest"]) == 0 and cli.main(["init"]) == 1
    assert cli.main(["validate", "sources.yaml"]) == 0
    assert cli.main(["diff", "sources.yaml"]) == 0 and "+ source api" in capsys.readouterr().out
    assert cli.main(["apply", "sources.yaml", "--dry-run"]) == 0 and cli.main(["apply", "sources.yaml", "--expected-version", "0"]) == 0
    assert cli.main(["apply", "sources.yaml", "--expected-version", "5"]) == 1
    capsys.readouterr()
    assert cli.main(["--output", "json", "domain", "history", "default"]) == 0 and json.loads(capsys.readouterr().out)[0]["version"] == 1
    (tmp_path / "bad.yaml").write_text("sources:\n  - {name: a, type: nope}\n  - {name: a, type: file, path: x}\n")
    assert cli.main(["validate", "bad.yaml"]) == 1


def test_contract_validation():
    raw = {"sources": [{"name": "s", "type": "file", "path": "x", "tables": [{"name": "users", "columns": [{"name": "id", "type": "int"}, {"name": "extra_col", "type": "int"}]}]}], "contracts": [{"table": "s.users", "strict": True, "columns": [{"name": "id", "type": "int"}, {"name": "email", "type": "string"}]}]}
    assert len(cli.validate(raw)) == 2


def test_rest_server(spark, sf):
    keys = server.KeyRing()
    keys.add("abcdefgh-secret", User("u"))
    s = server.serve(engine_over(spark, sf, ("nation",)), keys=keys)
    url = f"http://127.0.0.1:{s.server_port}/api/v1"

    def call(path, body=None, key="abcdefgh-secret"):
        r = urllib.request.Request(url + path, json.dumps(body).encode() if body is not None else None, {"Authorization": f"Bearer {key}"})
        return json.load(urllib.request.urlopen(r, timeout=60))

    assert call("/query", {"sql": "SELECT n_name FROM nation WHERE n_nationkey = 3"})["row_count"] == 1
    assert call("/sources")[0]["name"] == "nation" and call("/introspect/default/nation") == [{"schema": "public", "table": "nation"}]
    assert call("/introspect/default/nation/tables", {"tables": ["nation"]})[0]["columns"][0][0] == "n_nationkey"
    assert call("/validate", {"sources": [{"name": "x", "type": "bad"}]})["valid"] is False
    for key, body, status in (("abcdefgh-wrong", {"sql": "SELECT 1"}, 401), ("abcdefgh-secret", {"sql": "DROP TABLE x"}, 401), ("abcdefgh-secret", {"sql": "SELEC"}, 401), ("abcdefgh-secret", {}, 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            call("/query", body, key)
        assert e.value.code == status
    s.shutdown()


def test_flight_round_trip(spark, sf):
    flight = pytest.importorskip("pyarrow.flight")
    s = server.flight_server(engine_over(spark, sf, ("nation",)))
    threading.Thread(target=s.serve, daemon=True).start()
    url = f"grpc://127.0.0.1:{s.port}"
    client = flight.connect(url)
    info = client.get_flight_info(flight.FlightDescriptor.for_command(b"SELECT n_name FROM nation"))
    assert client.do_get(info.endpoints[0].ticket).read_all().num_rows == 25
    from quillon.engine import Engine

    config = SourceConfig("f", "flight_sql", url=url, tables=[TableConfig("nation", columns=[ColumnConfig("n_nationkey", "int"), ColumnConfig("n_name", "string")])])
    e = Engine(spark, AppConfig(sources=[config]))
    assert e.sql("SELECT n_name FROM f.nation WHERE n_nationkey < 4").to_arrow().num_rows == 4
    s.shutdown()


def test_search(spark, sf):
    cat = engine_over(spark, sf, ("nation", "customer", "orders")).catalog
    ix = SchemaIndex(cat)
    assert ix.search("customer market segment")[0].table == "customer" and ix.coverage() == 0 and len(ix.search("o", 3)) <= 3
    assert schema_details(cat, "nation")[0]["name"] == "n_nationkey" and schema_details(cat, "zzz") == []


def test_sandbox():
    out = sandbox.run("t = table('x')\nprint(sum(t['v'].to_pylist()))", {"x": pa.table({"v": [1, 2, 3]})})
    assert (out.stdout.strip(), out.code) == ("6", 0), out.stderr
    assert sandbox.run("while True: pass", seconds=2).code != 0
    for bad in ("import os", "open('x')", "().__class__", "from subprocess import run"):
        assert code_of(sandbox.run, bad) is Code.AUTHORIZATION_DENIED
    assert code_of(sandbox.run, "x = (") is Code.SYNTAX_ERROR


def test_did_you_mean():
    assert did_you_mean("custmer", ["customer", "orders"]) == "customer" and did_you_mean("zzzzzz", ["customer"]) is None


def test_streaming(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    aggs = [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v")]
    batch = streaming.windowed(events, "ts", "1 hour", ["event_type"], aggs)
    (tmp_path / "in").mkdir()
    import shutil

    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    stream = streaming.windowed(streaming.read_events(spark, str(tmp_path / "in"), events.schema), "ts", "1 hour", ["event_type"], aggs, late="365 days")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("w")) == key(batch)
    assert streaming.sessions(events, "ts", "30 minutes", ["user_id"], aggs).agg(F.sum("n")).first()[0] == events.count()
    sink = streaming.to_parquet(streaming.deduplicated(streaming.read_events(spark, str(tmp_path / "in"), events.schema), "ts", ["event_id"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    sink.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("event_id").distinct().count()


def test_coerce_keeps_what_it_cannot_say_out():
    from pyspark.sql import types as T

    from quillon.sources.datasource import coerce

    assert [coerce(v, T.BooleanType()) for v in ("false", "True", 0, 1, "x", False, 2)] == [False, True, False, True, None, False, None]
    assert [coerce(v, T.LongType()) for v in (2.0, 2.7, "3", "3.5", float("nan"), True)] == [2, None, 3, None, None, 1]


def test_rest_page_cap_warns_and_credentials_stay_home(monkeypatch):
    import io
    import json

    from quillon.sources import datasource

    seen = []

    class Answer(io.BytesIO):
        headers: dict = {}

    def answer(request, timeout):
        seen.append((request.full_url, dict(request.headers)))
        return Answer(json.dumps({"data": [{"a": 1}], "next": f"http://other.test/{len(seen)}" if len(seen) < 3 else None}).encode())

    monkeypatch.setattr(datasource.urllib.request, "urlopen", answer)
    o = {"base_url": "http://home.test/x", "pagination": {"type": "bodyurl", "path": "next"}, "auth": {"type": "bearer", "token": "t"}, "data_path": "data"}
    assert len(list(datasource.rest_pages(o))) == 3
    assert ["Authorization" in h for _, h in seen] == [True, False, False]
    seen.clear()
    with pytest.warns(UserWarning, match="max_pages"):
        assert len(list(datasource.rest_pages(o | {"max_pages": 2}))) == 2


def test_compat_keeps_columns_of_clashing_names(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quillon.functions import compat

    df = spark.createDataFrame([(1, 7, 8, 9), (1, 6, 5, 4)], "k int, __rn int, __qualify int, __group int")
    assert [tuple(r) for r in compat.distinct_on(df, ["k"], [F.col("__rn")]).collect()] == [(1, 6, 5, 4)]
    assert compat.qualify(df, F.row_number().over(Window.partitionBy("k").orderBy("__rn")) == 1).columns == df.columns
    assert [tuple(r) for r in compat.groups_frame(df, ["k"], ["__rn"], 1, 0, F.sum("__group"), "s").orderBy("s").collect()] == [(1, 6, 5, 4, 4), (1, 7, 8, 9, 13)]
    edges = {1: 2, 2: 3, 3: 1}
    step = lambda d: d.select((F.col("n") % 3 + 1).alias("n"))
    assert sorted(r.n for r in compat.recursive_distinct(spark.createDataFrame([(1,)], "n int"), step).collect()) == sorted(edges)
