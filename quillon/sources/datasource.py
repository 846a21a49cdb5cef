"""Python data sources over DB-API connections, REST and Arrow Flight SQL.

The classes only use what can be shipped to executors: options are strings, and libraries are
imported where they are used. Pushed filters are always handed back too, so Spark checks every row
again and a source that ignores or misreads one cannot give wrong rows.
"""

from __future__ import annotations

import datetime
import decimal
import itertools
import json
import urllib.parse
import urllib.request
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = 4096
_OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(value) -> str | None:
    """SQL text of a value, or None if there is none for it."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, decimal.Decimal)):
        return str(value)
    if isinstance(value, float):
        return repr(value) if value == value and abs(value) != float("inf") else None
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    return None


def condition(f: Filter) -> str | None:
    """SQL of a pushed filter on a top-level column, or None if it cannot be said."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column = quote(f.attribute[0])
    if isinstance(f, IsNull):
        return f"{column} IS NULL"
    if isinstance(f, IsNotNull):
        return f"{column} IS NOT NULL"
    if isinstance(f, In):
        values = [literal(v) for v in f.value]
        return f"{column} IN ({', '.join(values)})" if values and None not in values else None
    value = literal(getattr(f, "value", None))
    return f"{column} {_OPS[type(f)]} {value}" if type(f) in _OPS and value is not None else None


class _Range(InputPartition):
    """Rows of a table whose partition column lies in [low, high); None is open."""

    def __init__(self, low=None, high=None, nulls=False):
        self.low, self.high, self.nulls = low, high, nulls


def coerce(value, kind: T.DataType):
    """A fetched value as the declared type: integers widen, numbers become text, what does not fit is None.

    A fraction is no integer, and only true, false, 1 and 0, also as text, are booleans.
    """
    if value is None:
        return None
    try:
        if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            return int(value) if isinstance(value, str) or value == int(value) else None
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else json.dumps(value) if isinstance(value, (dict, list)) else str(value)
        if isinstance(kind, T.BooleanType):
            return {"true": True, "1": True, "t": True, "false": False, "0": False, "f": False}.get(str(value).strip().lower())
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(str(value))
        if isinstance(kind, T.DateType) and isinstance(value, str):
            return datetime.date.fromisoformat(value[:10])
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)) and isinstance(value, str):
            return datetime.datetime.fromisoformat(value)
    except (ValueError, ArithmeticError, TypeError):
        return None
    return value


class SqlReader(DataSourceReader):
    """Rows of a table or statement of a DB-API database, in ranges of a numeric column if one is named."""

    def __init__(self, options: dict, schema: T.StructType):
        self.o, self.schema, self.where = options, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            text = condition(f)
            if text and "query" not in self.o:
                self.where.append(text)
            yield f

    def partitions(self):
        column, n = self.o.get("partitioncolumn"), int(self.o.get("numpartitions", "1"))
        if not column or n < 2 or "query" in self.o:
            return [_Range()]
        with _connect(self.o) as db:
            low, high = db.execute(f"SELECT min({quote(column)}), max({quote(column)}) FROM {self.o['table']}").fetchone()
        if low is None:
            return [_Range()]
        step = max(1, -(-(int(high) - int(low) + 1) // n))
        cuts = [int(low) + step * i for i in range(1, n) if int(low) + step * i <= int(high)]
        return [_Range(a, b, a is None) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def statement(self, part: _Range) -> str:
        if "query" in self.o:
            return self.o["query"]
        where = list(self.where)
        column = quote(self.o.get("partitioncolumn", ""))
        bounds = [f"{column} >= {part.low}"] * (part.low is not None) + [f"{column} < {part.high}"] * (part.high is not None)
        if bounds:
            where.append(f"({' AND '.join(bounds)}" + (f" OR {column} IS NULL" if part.nulls else "") + ")")
        columns = ", ".join(quote(f.name) for f in self.schema.fields) or "1"
        return f"SELECT {columns} FROM {self.o['table']}" + (f" WHERE {' AND '.join(where)}" if where else "")

    def read(self, partition):
        kinds, schema = [f.dataType for f in self.schema.fields], to_arrow_schema(self.schema)
        with _connect(self.o) as db:
            cursor = db.execute(self.statement(partition))
            if self.o["engine"] == "duckdb":
                for batch in cursor.to_arrow_reader(16 * BATCH):
                    yield arrow_rows(batch, kinds, schema)
                return
            while rows := cursor.fetchmany(BATCH):
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([coerce(v, k) for v in c], f.type) for c, k, f in zip(columns, kinds, schema, strict=False)], schema=schema)


def arrow_rows(batch: pa.RecordBatch, kinds: list[T.DataType], schema: pa.Schema) -> pa.RecordBatch:
    """A batch in the declared types; a column that Arrow cannot cast goes value by value."""
    columns = []
    for column, kind, f in zip(batch.columns, kinds, schema, strict=True):
        try:
            columns.append(column.cast(f.type))
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            columns.append(pa.array([coerce(v, kind) for v in column.to_pylist()], f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class _connect:
    def __init__(self, options: dict):
        self.o = options

    def __enter__(self):
        if self.o["engine"] == "sqlite":
            import sqlite3

            self.db = sqlite3.connect(f"file:{urllib.parse.quote(self.o['path'])}?mode=ro", uri=True)
        else:
            import duckdb

            self.db = duckdb.connect(self.o["path"], read_only=True)
        return self.db

    def __exit__(self, *_):
        self.db.close()


class SqlDataSource(DataSource):
    """``format("quillon_sql")``: engine (sqlite or duckdb), path, and table or query; the schema is given."""

    @classmethod
    def name(cls):
        return "quillon_sql"

    def reader(self, schema):
        return SqlReader({k.lower(): v for k, v in self.options.items()}, schema)


def _dig(value, path: str):
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


class RestReader(DataSourceReader):
    """Pages of a JSON endpoint, followed to their end (or to ``max_pages``)."""

    def __init__(self, options: dict, schema: T.StructType):
        self.o, self.schema = json.loads(options["config"]), schema
        self.params: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            for rule in self.o.get("pushdown", []):
                if getattr(f, "attribute", None) == (rule["column"],) and _OPS.get(type(f)) == rule.get("operator", "="):
                    self.params[rule["param"]] = str(f.value)
            yield f

    def read(self, partition):
        kinds, schema = [(f.name, f.dataType) for f in self.schema.fields], to_arrow_schema(self.schema)
        for page in rest_pages(self.o, self.params):
            for lo in range(0, len(page), BATCH):
                rows = page[lo : lo + BATCH]
                yield pa.RecordBatch.from_arrays([pa.array([coerce(r.get(n), k) for r in rows], f.type) for (n, k), f in zip(kinds, schema, strict=True)], schema=schema)


def rest_headers(o: dict) -> dict[str, str]:
    """Headers of the configured auth: basic, bearer, or OAuth2 client credentials."""
    import base64

    headers, auth = dict(o.get("headers") or {}), o.get("auth") or {}
    kind = auth.get("type")
    if kind == "basic":
        headers["Authorization"] = "Basic " + base64.b64encode(f"{auth['username']}:{auth['password']}".encode()).decode()
    elif kind == "bearer":
        headers["Authorization"] = f"Bearer {auth['token']}"
    elif kind in ("oauth", "oauth_client_credentials"):
        body = {"grant_type": "client_credentials", "client_id": auth["client_id"], "client_secret": auth["client_secret"], **({"scope": " ".join(auth["scopes"])} if auth.get("scopes") else {})}
        with urllib.request.urlopen(urllib.request.Request(auth["token_url"], urllib.parse.urlencode(body).encode()), timeout=30) as r:
            headers["Authorization"] = f"Bearer {json.load(r)['access_token']}"
    elif kind:
        raise ValueError(f"auth {kind!r} is not supported")
    return headers


def rest_pages(o: dict, params: dict[str, str] | None = None) -> Iterator[list[dict]]:
    """Record lists of each page. Pagination: header, body url, token, or indices; none is one page.

    Pages are read to the last one, unless ``max_pages`` is set: where it cuts pages off, a warning
    says so. Next pages on another origin are asked without the configured headers, which hold credentials.
    """
    paging, headers = o.get("pagination") or {}, rest_headers(o)
    kind, most = paging.get("type"), int(o["max_pages"]) if o.get("max_pages") else None
    offset, extra, url = int(paging.get("initial_offset", 0)), dict(params or {}), o["base_url"] + (o.get("path") or "")
    home = origin(o["base_url"])
    for page in itertools.count(1):
        query = dict(extra)
        if kind == "indices":
            query |= {paging["param_offset"]: str(offset), paging["param_limit"]: str(paging["limit"])}
        if origin(url) != home:
            headers = {}
        at = url + (("&" if "?" in url else "?") + urllib.parse.urlencode(query) if query else "")
        body = json.dumps(o["body"]).encode() if o.get("body") is not None else None
        request = urllib.request.Request(at, body, headers, method=o.get("method", "GET"))
        with urllib.request.urlopen(request, timeout=float(o.get("timeout", 60))) as r:
            answer, link = json.load(r), r.headers.get(paging.get("header_name", "Link"))
        data = _dig(answer, o["data_path"]) if o.get("data_path") else answer
        if isinstance(data, dict):
            data = next((v for k in ("data", "items", "results", "records") if isinstance(v := data.get(k), list)), [data])
        data = [x for x in data or [] if isinstance(x, dict)]
        if data:
            yield data
        if kind == "header" and link:
            import re

            m = re.search(r'<([^>]+)>\s*;\s*rel="?next"?', link) or (re.match(r"\s*(http\S+)\s*$", link) if "<" not in link else None)
            url = m[1] if m else None
            extra = {}
        elif kind == "bodyurl":
            url, extra = _dig(answer, paging["path"]), {}
        elif kind == "token":
            token = _dig(answer, paging["token_path"])
            extra = {**(params or {}), paging["param_name"]: str(token)}
            url = url if token else None
        elif kind == "indices":
            offset += int(paging["limit"])
            url = url if data else None
        else:
            return
        if not url or not str(url).startswith("http"):
            return
        if page == most:
            warnings.warn(f"{o['base_url']}: cut off after max_pages = {most} pages", stacklevel=2)
            return


def origin(url: str) -> tuple:
    """Scheme, host and port of a URL."""
    u = urllib.parse.urlsplit(url)
    return u.scheme, u.hostname, u.port or {"http": 80, "https": 443}.get(u.scheme)


class RestDataSource(DataSource):
    @classmethod
    def name(cls):
        return "quillon_rest"

    def reader(self, schema):
        return RestReader(self.options, schema)


class FlightReader(DataSourceReader):
    """Endpoints of a Flight SQL statement, one partition each."""

    def __init__(self, options: dict, schema: T.StructType):
        self.o, self.schema = options, schema

    def partitions(self):
        import pyarrow.flight as flight

        client = flight.connect(self.o["url"])
        info = client.get_flight_info(flight.FlightDescriptor.for_command(self.o["query"].encode()), flight_options(self.o))
        return [_Ticket(e.ticket.serialize()) for e in info.endpoints]

    def read(self, partition):
        import pyarrow.flight as flight

        schema = to_arrow_schema(self.schema)
        for chunk in flight.connect(self.o["url"]).do_get(flight.Ticket.deserialize(partition.ticket), flight_options(self.o)):
            yield from pa.Table.from_batches([chunk.data]).select(schema.names).cast(schema).to_batches()


def flight_options(o: dict):
    import pyarrow.flight as flight

    return flight.FlightCallOptions(headers=[(b"authorization", f"Bearer {o['token']}".encode())] if o.get("token") else [])


class _Ticket(InputPartition):
    def __init__(self, ticket: bytes):
        self.ticket = ticket


class FlightDataSource(DataSource):
    @classmethod
    def name(cls):
        return "quillon_flight"

    def reader(self, schema):
        return FlightReader({k.lower(): v for k, v in self.options.items()}, schema)


def register(spark) -> None:
    """Makes the sources known to a session, once, and lets Spark push filters to them."""
    if getattr(spark, "_quillon_sources", None) is None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        for kind in (SqlDataSource, RestDataSource, FlightDataSource):
            spark.dataSource.register(kind)
        spark._quillon_sources = True
