"""Versioned configuration of domains in SQLite: apply with an optimistic lock, history, rollback."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import time
from dataclasses import dataclass

from quillon.errors import Code, make


@dataclass(frozen=True)
class Version:
    domain: str
    version: int
    at: float
    author: str
    sha256: str
    config: dict


def digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


class Metastore:
    def __init__(self, path: str):
        self.db = sqlite3.connect(path)
        self.db.execute("CREATE TABLE IF NOT EXISTS versions (domain TEXT, version INTEGER, at REAL, author TEXT, sha256 TEXT, config TEXT, PRIMARY KEY (domain, version))")

    def current(self, domain: str) -> Version | None:
        r = self.db.execute("SELECT * FROM versions WHERE domain = ? ORDER BY version DESC LIMIT 1", (domain,)).fetchone()
        return Version(*r[:5], json.loads(r[5])) if r else None

    def history(self, domain: str) -> list[Version]:
        return [Version(*r[:5], json.loads(r[5])) for r in self.db.execute("SELECT * FROM versions WHERE domain = ? ORDER BY version", (domain,))]

    def domains(self) -> list[str]:
        return [r[0] for r in self.db.execute("SELECT DISTINCT domain FROM versions ORDER BY domain")]

    def apply(self, domain: str, config: dict, expected: int | None = None, author: str = "", dry_run: bool = False) -> Version:
        """A new version; the same configuration again is no version. ``expected`` is the version it was made from."""
        with self.db:
            self.db.execute("BEGIN IMMEDIATE")
            now = self.current(domain)
            have = now.version if now else 0
            if expected is not None and expected != have:
                raise make(Code.CONFIG_ERROR, f"domain '{domain}' is at version {have}, not {expected}", "diff again, then apply")
            made = Version(domain, have + 1, time.time(), author, digest(config), config)
            if now and now.sha256 == made.sha256:
                return now
            if not dry_run:
                self.db.execute("INSERT INTO versions VALUES (?, ?, ?, ?, ?, ?)", (made.domain, made.version, made.at, made.author, made.sha256, json.dumps(config, default=str)))
            return made

    def rollback(self, domain: str, version: int, author: str = "") -> Version:
        """The configuration of an old version, as a new one."""
        for v in self.history(domain):
            if v.version == version:
                return self.apply(domain, v.config, author=author)
        raise make(Code.CONFIG_ERROR, f"domain '{domain}' has no version {version}")


def diff(old: dict | None, new: dict) -> list[str]:
    """Lines + - ~ of sources, tables and columns that come, go and change."""

    def flat(config: dict | None) -> dict[str, object]:
        out: dict[str, object] = {}
        for s in (config or {}).get("sources", []):
            out[f"source {s['name']}"] = {k: v for k, v in s.items() if k != "tables"}
            for t in s.get("tables", []):
                out[f"table {s['name']}.{t['name']}"] = {k: v for k, v in t.items() if k != "columns"}
                for c in t.get("columns", []):
                    out[f"column {s['name']}.{t['name']}.{c['name']}"] = c
        return out

    a, b = flat(old), flat(new)
    return [f"- {k}" for k in a if k not in b] + [f"+ {k}" for k in b if k not in a] + [f"~ {k}" for k in b if k in a and a[k] != b[k]]
