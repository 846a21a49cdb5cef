"""Declarative configuration: dataclasses, YAML with ``${VAR}`` secrets, environment overrides."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints

import yaml

from quillon.errors import Code, make

ENV_PREFIX = "QUILLON_"


@dataclass
class RetrySettings:
    max_attempts: int = 5
    base_delay_ms: int = 1000
    max_delay_ms: int = 60_000


@dataclass
class CacheConfig:
    enabled: bool = True
    directory: str | None = None
    ttl_seconds: int = 3600
    max_size_mb: int = 10_240


@dataclass
class QueryLimits:
    """One set of defaults for every entry point. None switches a limit off."""

    default_limit: int | None = None
    max_output_rows: int | None = None
    max_scan_bytes: int | None = None
    timeout_seconds: int = 300
    max_concurrent: int = 100


@dataclass
class ColumnConfig:
    name: str
    type: str
    length: int | None = None
    primary_key: bool = False
    unique: bool = False
    not_null: bool = False
    comment: str | None = None


@dataclass
class TableConfig:
    name: str
    schema: str = "public"
    partition_column: str | None = None
    path: str | None = None
    columns: list[ColumnConfig] = field(default_factory=list)


@dataclass
class SourceConfig:
    name: str
    type: str
    url: str | None = None
    username: str | None = None
    password: str | None = None
    default_limit: int | None = None
    max_concurrent_queries: int = 0
    cache: CacheConfig | None = None
    tables: list[TableConfig] = field(default_factory=list)
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class Constraint:
    type: str
    value: Any = None


@dataclass
class ContractColumn:
    name: str
    type: str
    nullable: bool = True
    constraints: list[Constraint] = field(default_factory=list)


@dataclass
class Contract:
    table: str
    strict: bool = False
    columns: list[ContractColumn] = field(default_factory=list)


@dataclass
class AppConfig:
    catalog: str = "quillon"
    domain: str | None = None
    cache: CacheConfig = field(default_factory=lambda: CacheConfig(enabled=False))
    query_limits: QueryLimits = field(default_factory=QueryLimits)
    retry: RetrySettings = field(default_factory=RetrySettings)
    sources: list[SourceConfig] = field(default_factory=list)
    contracts: list[Contract] = field(default_factory=list)


def expand_secrets(text: str, env: dict[str, str] | None = None) -> str:
    """``${VAR}`` from the environment; what is unset stays as written."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: env.get(m[1], m[0]), text)


def build(kind: type, raw: Any, where: str = "config") -> Any:
    """A dataclass of nested mappings and lists; loose keys of a source go to its options."""
    if not isinstance(raw, dict):
        raise make(Code.CONFIG_ERROR, f"{where}: a mapping is expected")
    hints, known, out = get_type_hints(kind), {f.name: f for f in fields(kind)}, {}
    for key, value in raw.items():
        if key not in known:
            if "options" in known:
                out.setdefault("options", {})[key] = value
                continue
            raise make(Code.SCHEMA_VIOLATION, f"{where}: unknown key {key!r}", key=key)
        inner = [t for t in (hints[key], *getattr(hints[key], "__args__", ())) if is_dataclass(t)]
        if inner and isinstance(value, list):
            out[key] = [build(inner[0], v, f"{where}.{key}[{i}]") for i, v in enumerate(value)]
        elif inner and isinstance(value, dict):
            out[key] = build(inner[0], value, f"{where}.{key}")
        elif key == "options":
            out.setdefault("options", {}).update(value or {})
        else:
            out[key] = value
    missing = [n for n, f in known.items() if n not in out and f.default is f.default_factory]
    if missing:
        raise make(Code.MISSING_FIELD, f"{where}: missing {', '.join(missing)}", fields=missing)
    return kind(**out)


def parse_yaml(text: str) -> dict:
    try:
        return yaml.safe_load(expand_secrets(text)) or {}
    except yaml.YAMLError as e:
        raise make(Code.INVALID_YAML, str(e).split("\n")[0]) from e


def override(raw: dict, env: dict[str, str] | None = None) -> dict:
    """``QUILLON_A__B=value`` sets raw['a']['b']; values are read as YAML."""
    for name, value in (os.environ if env is None else env).items():
        if not name.startswith(ENV_PREFIX) or "__" not in name:
            continue
        *path, last = name[len(ENV_PREFIX) :].lower().split("__")
        at = raw
        for p in path:
            at = at.setdefault(p, {})
        at[last] = yaml.safe_load(value)
    return raw


def load_config(path: str, sources_path: str | None = None, env: dict[str, str] | None = None) -> AppConfig:
    """The main file, plus sources.yaml from ``sources_path`` or beside it."""
    raw = override(parse_yaml(Path(path).read_text()), env)
    beside = Path(sources_path) if sources_path else Path(path).parent / "sources.yaml"
    if beside.exists() and beside.resolve() != Path(path).resolve():
        more = parse_yaml(beside.read_text())
        raw["sources"] = [*raw.get("sources", []), *more.get("sources", [])]
        raw.setdefault("domain", more.get("domain"))
    return build(AppConfig, {k: v for k, v in raw.items() if v is not None})


SECRET_KEYS = re.compile(r"(?i)password|secret|token|api_?key|private_key|connection")


def redacted(value: Any, key: str = "") -> Any:
    """``value`` for display, without secrets."""
    if isinstance(value, dict):
        return {k: redacted(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v, key) for v in value]
    return "***" if value is not None and SECRET_KEYS.search(key) else value
