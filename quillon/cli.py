"""Command line: init, validate, diff, apply, search, introspect, test-connection, describe, domain."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from quillon.config import AppConfig, build, parse_yaml
from quillon.errors import Code, EngineError, make
from quillon.metastore import Metastore, diff
from quillon.sources.registry import default_registry

TEMPLATES = {
    "file": "domain: default\nsources:\n  - name: sales\n    type: parquet\n    path: data/sales/*.parquet\n",
    "sql": "domain: default\nsources:\n  - name: shop\n    type: sql\n    dialect: postgres\n    connection: ${DATABASE_URL}\n    tables:\n      - name: orders\n        partition_column: order_id\n",
    "rest": "domain: default\nsources:\n  - name: api\n    type: rest\n    base_url: https://example.com/items\n    pagination: {type: indices, param_offset: offset, param_limit: limit, limit: 100}\n",
    "grpc": "domain: default\nsources:\n  - name: svc\n    type: grpc\n    url: grpc://localhost:50051\n    service: shop.Items\n    method: List\n",
}


def read(path: str) -> dict:
    return parse_yaml(Path(path).read_text())


def validate(raw: dict) -> list[str]:
    """Problems of a sources file, by its shape, source types, names and contracts."""
    try:
        config = build(AppConfig, {k: v for k, v in raw.items() if v is not None})
    except EngineError as e:
        return [str(e)]
    out, registry, seen = [], default_registry(), set()
    for s in config.sources:
        if s.name in seen:
            out.append(f"source '{s.name}' is there twice")
        seen.add(s.name)
        try:
            registry.get(s.type)
        except EngineError as e:
            out.append(str(e))
        for t in s.tables:
            names = [c.name for c in t.columns]
            out += [f"column '{s.name}.{t.name}.{n}' is there twice" for n in sorted({n for n in names if names.count(n) > 1})]
            for c in config.contracts:
                if c.strict and c.table.split(".")[-1] == t.name and names:
                    out += [f"column '{t.name}.{n}' is not in the strict contract" for n in names if n not in {x.name for x in c.columns}]
                    out += [f"column '{t.name}.{x.name}' of the contract is missing" for x in c.columns if x.name not in names]
    return out


def _engine(raw: dict):
    from pyspark.sql import SparkSession

    from quillon.engine import Engine

    return Engine(SparkSession.builder.appName("quillon-cli").getOrCreate(), build(AppConfig, raw))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("quillon")
    p.add_argument("--store", default=".quillon.db")
    p.add_argument("--output", choices=("human", "json"), default="human")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init")
    c.add_argument("--template", choices=sorted(TEMPLATES), default="file")
    c.add_argument("--path", default="sources.yaml")
    for name in ("validate", "diff", "apply", "introspect", "test-connection", "search", "describe"):
        c = sub.add_parser(name)
        c.add_argument("file")
        if name == "apply":
            c.add_argument("--expected-version", type=int)
            c.add_argument("--dry-run", action="store_true")
            c.add_argument("--author", default="")
        if name in ("search", "describe"):
            c.add_argument("what")
    c = sub.add_parser("domain")
    c.add_argument("action", choices=("list", "history", "rollback"))
    c.add_argument("name", nargs="?")
    c.add_argument("version", nargs="?", type=int)
    a = p.parse_args(argv)

    def say(value, lines: list[str]) -> None:
        print(json.dumps(value, default=str) if a.output == "json" else "\n".join(lines))

    try:
        if a.command == "init":
            if Path(a.path).exists():
                raise make(Code.CONFIG_ERROR, f"{a.path} exists")
            Path(a.path).write_text(TEMPLATES[a.template])
            say({"written": a.path}, [f"wrote {a.path}"])
        elif a.command == "domain":
            store = Metastore(a.store)
            if a.action == "list":
                say(store.domains(), store.domains())
            elif a.action == "history":
                h = store.history(a.name)
                say([{"version": v.version, "sha256": v.sha256, "author": v.author, "at": v.at} for v in h], [f"{v.version}\t{v.sha256[:12]}\t{v.author}" for v in h])
            else:
                v = store.rollback(a.name, a.version)
                say({"version": v.version}, [f"domain {a.name} is at version {v.version}"])
        else:
            raw = read(a.file)
            domain = raw.get("domain") or "default"
            problems = validate(raw)
            if a.command in ("validate", "apply") and problems:
                say({"valid": False, "problems": problems}, problems)
                return 1
            if a.command == "validate":
                say({"valid": True, "problems": []}, ["valid"])
            elif a.command in ("diff", "apply"):
                store = Metastore(a.store)
                now = store.current(domain)
                changes = diff(now.config if now else None, raw)
                if a.command == "apply":
                    v = store.apply(domain, raw, a.expected_version, a.author, a.dry_run)
                    say({"version": v.version, "changes": changes, "dry_run": a.dry_run}, [*changes, f"{'would be' if a.dry_run else 'now'} version {v.version}"])
                else:
                    say(changes, changes or ["no changes"])
            elif a.command == "test-connection":
                e = _engine(raw)
                found = {s["name"]: str(e.catalog.errors.get(s["name"], "ok")) for s in raw.get("sources", [])}
                say(found, [f"{k}\t{v}" for k, v in found.items()])
                return int(any(v != "ok" for v in found.values()))
            elif a.command == "introspect":
                e = _engine(raw)
                found = [{"schema": s, "table": t, "columns": [(f.name, f.dataType.simpleString()) for f in x.load().schema]} for (s, t), x in sorted(e.catalog.tables.items())]
                say(found, [f"{x['schema']}.{x['table']}\t{', '.join(' '.join(c) for c in x['columns'])}" for x in found])
            elif a.command == "search":
                from quillon.search import SchemaIndex

                hits = SchemaIndex(_engine(raw).catalog).search(a.what)
                say([vars(h) for h in hits], [f"{h.schema}.{h.table}.{h.column}\t{h.score:.2f}" for h in hits])
            elif a.command == "describe":
                from quillon.search import schema_details

                rows = schema_details(_engine(raw).catalog, a.what)
                say(rows, [f"{r['name']}\t{r['type']}" for r in rows])
    except (EngineError, OSError) as e:
        print(e.to_json() if a.output == "json" and isinstance(e, EngineError) else e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
