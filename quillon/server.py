"""REST surface under /api/v1, with API keys and a bounded number of requests at a time."""

from __future__ import annotations

import hashlib
import hmac
import http.server
import json
import threading
import urllib.parse

from quillon.adapters import Slots
from quillon.cli import validate
from quillon.engine import Engine
from quillon.errors import Code, EngineError, make
from quillon.policy import User


class KeyRing:
    """API keys by their first 8 characters; only salted hashes are held."""

    def __init__(self, salt: bytes = b"quillon"):
        self.salt, self.held = salt, {}

    def _hash(self, key: str) -> bytes:
        return hashlib.scrypt(key.encode(), salt=self.salt, n=1 << 12, r=8, p=1)

    def add(self, key: str, user: User) -> None:
        self.held.setdefault(key[:8], []).append((self._hash(key), user))

    def user(self, header: str | None) -> User:
        if not header or not header.startswith("Bearer "):
            raise make(Code.AUTHENTICATION_FAILED, "a bearer API key is needed")
        key = header.removeprefix("Bearer ").strip()
        for digest, user in self.held.get(key[:8], []):
            if hmac.compare_digest(digest, self._hash(key)):
                return user
        raise make(Code.INVALID_API_KEY, "unknown API key")


def handler(engine: Engine, keys: KeyRing | None, slots: Slots):
    class Handler(http.server.BaseHTTPRequestHandler):
        def _send(self, status: int, body) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _run(self, f) -> None:
            try:
                with slots:
                    user = keys.user(self.headers.get("Authorization")) if keys else None
                    self._send(200, f(user))
            except EngineError as e:
                self._send({"auth": 401, "query": 400, "config": 400}.get(e.category, 500), e.to_dict())
            except KeyError as e:
                self._send(400, make(Code.MISSING_FIELD, f"missing {e}").to_dict())

        def do_GET(self):
            parts = [urllib.parse.unquote(p) for p in urllib.parse.urlparse(self.path).path.strip("/").split("/")]
            if parts[:3] == ["api", "v1", "sources"]:
                return self._run(lambda u: json.loads(engine.list_sources()))
            if parts[:3] == ["api", "v1", "introspect"] and len(parts) == 5:
                return self._run(lambda u: [{"schema": s, "table": t} for (s, t), src in engine.catalog.source_of.items() if src == parts[4]])
            return self._send(404, {"message": "no such path"})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
            path = urllib.parse.urlparse(self.path).path.rstrip("/")
            if path == "/api/v1/query":

                def run(user):
                    result = engine.sql(body["sql"], user, body.get("params"))
                    rows = result.to_arrow().to_pylist()
                    return {"rows": rows, "row_count": len(rows), "warnings": result.warnings}

                return self._run(run)
            if path in ("/api/v1/validate", "/api/v1/validate-contracts"):
                return self._run(lambda u: {"problems": (p := validate(body)), "valid": not p})
            if path.startswith("/api/v1/introspect/") and path.endswith("/tables"):
                names = body.get("tables") or []
                return self._run(lambda u: [{"table": t, "columns": [[f.name, f.dataType.simpleString()] for f in x.load().schema]} for (s, t), x in engine.catalog.tables.items() if t in names])
            return self._send(404, {"message": "no such path"})

        def log_message(self, *_):
            pass

    return Handler


def serve(engine: Engine, port: int = 0, keys: KeyRing | None = None, at_once: int = 16, wait: float = 30) -> http.server.ThreadingHTTPServer:
    """A running server; ``server.server_port`` tells where. ``server.shutdown()`` ends it."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", port), handler(engine, keys, Slots(at_once, wait)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def flight_server(engine: Engine, location: str = "grpc://127.0.0.1:0"):
    """An Arrow Flight server: a descriptor's command is SQL text, and so is the ticket; rows leave batch by batch."""
    import pyarrow.flight as flight
    from pyspark.sql.pandas.types import to_arrow_schema

    class Server(flight.FlightServerBase):
        def get_flight_info(self, context, descriptor):
            result = engine.sql(descriptor.command.decode())
            endpoint = flight.FlightEndpoint(descriptor.command, [self.location])
            return flight.FlightInfo(to_arrow_schema(result.schema), descriptor, [endpoint], -1, -1)

        def do_get(self, context, ticket):
            return flight.RecordBatchStream(engine.sql(ticket.ticket.decode()).to_arrow())

        @property
        def location(self):
            return f"grpc://127.0.0.1:{self.port}"

    return Server(location)
